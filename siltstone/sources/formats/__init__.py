"""Format handlers. Importing this package registers all of them."""

from . import biff, mail, markup, office, packages, plain, records  # noqa: F401
from .base import Document, Section, Unreadable, handler, handler_for, handlers, parse  # noqa: F401
