"""Payloads without personal data: nested columns cleaned by their schema, and packed with a shared dictionary."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from . import scalar as S

# Fixed values.
FORBIDDEN = (
    "query user_query raw_query search_query content raw_content document_content chunk_content text raw_text body title document_title doc_title file_path filepath path source_path "
    "filename file_name cpf cnpj ssn rg email user_email password passwd secret token api_key access_token bearer_token snippet text_snippet excerpt username full_name author"
).split()
MAX_BYTES = 1_048_576


def _clean(value: Column, kind: Ty.DataType, forbidden: list[str]) -> Column:
    """A value of any type without forbidden fields and keys, at any depth, and with personal data in its texts replaced by marks."""
    if isinstance(kind, Ty.StringType):
        return S.scrub(value)
    if isinstance(kind, Ty.ArrayType):
        return F.transform(value, lambda x: _clean(x, kind.elementType, forbidden))
    if isinstance(kind, Ty.MapType):
        kept = F.map_filter(value, lambda k, v: ~F.lower(F.trim(k.cast("string"))).isin(forbidden))
        return F.transform_values(kept, lambda k, v: _clean(v, kind.valueType, forbidden))
    if isinstance(kind, Ty.StructType):
        fields = [_clean(value[f.name], f.dataType, forbidden).alias(f.name) for f in kind.fields if f.name.strip().lower() not in forbidden]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else F.lit(None).cast("string")
    return value


def sanitize(rows: DataFrame, forbidden: list[str] = FORBIDDEN) -> DataFrame:
    """All columns but forbidden ones, cleaned. Null stays null."""
    return rows.select(*(_clean(F.col(f"`{f.name}`"), f.dataType, forbidden).alias(f.name) for f in rows.schema.fields if f.name.strip().lower() not in forbidden))


def violations(rows: DataFrame, forbidden: list[str] = FORBIDDEN) -> list[str]:
    """The forbidden fields of a schema, with dots for depth; a strict caller refuses such a table before it is read."""

    def walk(kind: Ty.DataType, path: str) -> list[str]:
        if isinstance(kind, Ty.ArrayType):
            return walk(kind.elementType, path + "[]")
        if isinstance(kind, Ty.MapType):
            return walk(kind.valueType, path + "{}")
        if isinstance(kind, Ty.StructType):
            return [x for f in kind.fields for x in ([f"{path}.{f.name}".lstrip(".")] if f.name.strip().lower() in forbidden else walk(f.dataType, f"{path}.{f.name}"))]
        return []

    return walk(rows.schema, "")


def has_personal_data(text: Column) -> Column:
    """Does scrubbing change a text?"""
    return F.coalesce(S.scrub(text) != text, F.lit(False))


def pack(payload: Column, dictionary: bytes = b"", level: int = 3) -> Column:
    """A JSON text in canonical form, compressed; with a dictionary's raw bytes as what comes before it. Null stays null; what is no JSON fails the task."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=known)
        return texts.map(lambda t: None if t is None else packer.compress(json.dumps(json.loads(t), separators=(",", ":"), sort_keys=True).encode()))

    return run(payload)


def unpack(packed: Column, dictionary: bytes = b"") -> Column:
    """The JSON text of a packed payload of at most MAX_BYTES. Null stays null."""

    @F.pandas_udf("string")
    def run(blobs: pd.Series) -> pd.Series:
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        unpacker = zstandard.ZstdDecompressor(dict_data=known)
        return blobs.map(lambda b: None if b is None else unpacker.decompress(b, max_output_size=MAX_BYTES).decode())

    return run(packed)
