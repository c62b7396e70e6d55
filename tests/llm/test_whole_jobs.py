"""What the operators did not do to the end before: each test failed on the code before its change."""

import hashlib
import random

from seekspark.llm import near_dedup, queries
from seekspark.llm.common import Scratch

from .test_dedup import brute_near, docs_of, rows_of


def forms(n=1000, fields=7, seed=5):
    """Filled forms of one template: any two lie just under the threshold, those two that agree in a field just above it."""
    r = random.Random(seed)
    template = [f"w{k}" for k in range(404)]
    pairs = []
    for i in range(n):
        words = list(template)
        for f in range(fields):
            words[30 + 55 * f] = f"f{f}v{i}"
        if i % 10 == 9:
            f = r.randrange(fields)
            words[30 + 55 * f] = f"f{f}v{i - 9}"
        pairs.append((r.randrange(10) * n + i, " ".join(words)))
    return pairs


def test_near_duplicates_among_look_alikes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "ROWS", 300, raising=False)  # several blocks
    pairs = forms()
    got = near_dedup.near_duplicates(docs_of(spark, pairs), Scratch(spark, "t"), percent=85)
    want = brute_near(pairs)
    assert sum(not x[3] for x in want) == 100
    assert rows_of(got.select("doc_id", "n_shingles", "component_id", "kept")) == want


def test_single_lines(spark, tmp_path):
    """A line of 20 words goes where it occurs again, between other lines and as a whole text; one of 19 words stays."""
    long, short = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(19))
    texts = [f"one\n{long}\ntwo\n{short}", f"three\n  {long} \nfour", long, f"{short}\nfive\n\n{long}\n\n{long}\nsix", short, None]
    docs_of(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op4_line_dedup(spark, str(tmp_path)).select("doc_id", "lines_removed", "kept_sha256").collect())
    kept = [texts[0], "three\nfour", "", f"{short}\nfive\n\nsix", short, None]
    want = [(i, n, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, (n, t) in enumerate(zip([0, 1, 1, 2, 0, 0], kept, strict=True))]
    assert [tuple(x) for x in got] == want
