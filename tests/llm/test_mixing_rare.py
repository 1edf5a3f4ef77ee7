"""Sources beyond the MAX_VALUES largest share one target and stay in the mix."""

import pytest

from siltstone.llm import mixing


@pytest.mark.parametrize("null_tokens", [0, 3, 5000])
def test_rare_sources_share_other(spark, null_tokens):
    n = mixing.MAX_VALUES + 60
    sizes = {f"s{i:03}": 9 + n - i for i in range(n)}
    rows = [(i, "w " * (size - 1), "en", source) for i, (source, size) in enumerate(sizes.items())]
    rows += [(n, "w " * (null_tokens - 1), "en", None)] * bool(null_tokens)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    whole = sorted([*sizes.items(), *[(mixing.OTHER, null_tokens)] * bool(null_tokens)], key=lambda x: (-x[1], x[0]))
    counts = dict(whole[: mixing.MAX_VALUES])
    counts[mixing.OTHER] = counts.get(mixing.OTHER, 0) + sum(size for _, size in whole[mixing.MAX_VALUES :])
    total = sum(counts.values())
    weights = {k: (v / total) ** 0.8 for k, v in counts.items()}
    shares = {k: w / sum(weights.values()) for k, w in weights.items()}
    targets = mixing.tempered(mixing.with_margins(docs))["source"]
    assert targets.keys() == shares.keys() and all(abs(targets[k] - shares[k]) < 1e-12 for k in shares)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r.probability > 0 for r in got)
    rare = {i for i, source in enumerate(sizes) if source not in counts}
    assert rare and {r.source for r in got if r.doc_id in rare} == {mixing.OTHER}
