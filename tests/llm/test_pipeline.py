"""The pipeline's stages against plain Python, each on what the one before kept."""

from collections import Counter

from test_jaccard import brute, sets
from test_rows import groups
from test_text_rules import stats
from test_tokens import BYTES, held, whole

import __spark_entry__
import corpus_pipeline
from stowage.plans.scratch import materialise


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        seen[name] = (before, docs.collect())
        before = seen[name][1]
        assert name == "packing" or docs.columns == columns
    given, kept = seen["quality_rules"]
    ids = {r["doc_id"] for r in kept}
    assert all(r["doc_id"] not in ids for r in given if stats(r["text"])["base_failed"])
    good = [r for r in given if labels.get(r["doc_id"]) == 1 and not stats(r["text"])["base_failed"]]
    assert sum(r["doc_id"] in ids for r in good) >= 0.97 * len(good)
    given, kept = seen["exact_duplicates"]
    want, _ = groups([(r["doc_id"], r["text"]) for r in given])
    assert sorted(r["doc_id"] for r in kept) == sorted({k for _, k, _, _ in want})
    given, kept = seen["near_duplicates"]
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, _, c in brute([(r["doc_id"], r["text"]) for r in given])})
    given, kept = seen["mixing"]
    assert {r["doc_id"] for r in kept} <= {r["doc_id"] for r in given} and len(kept) > len(given) / 2
    given, pieces = seen["packing"]
    copies = Counter(r["doc_id"] for r in given)
    lengths = Counter()
    for r in pieces:
        lengths[r["doc_id"]] += r["length"]
    for r in {r["doc_id"]: r for r in given}.values():
        assert lengths[r["doc_id"]] == copies[r["doc_id"]] * (len(whole(BYTES, r["text"])) // 4 + 1)
    held(pieces, 2048)


def test_near_duplicates_from_80_percent(spark, sf_dir):
    """Copies with 80 to 85 percent of five-word shingles in common go, those below stay."""
    rows = []
    for k, more in enumerate((74, 80, 90, 99, 100, 120)):
        text = [f"w{k}x{n}" for n in range(400)]
        rows += [(10 * k, " ".join(text)), (10 * k + 1, " ".join(text + [f"v{k}x{n}" for n in range(more)]))]
    known = {i: sets(t, 5) for i, t in rows}
    gone = {b for a, b in ((10 * k, 10 * k + 1) for k in range(6)) if 100 * len(known[a] & known[b]) >= 80 * len(known[a] | known[b])}
    assert gone == {1, 11, 21, 31}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert kept == {i for i, _ in rows} - gone


LONG = " ".join(f"w{n % 5000}x{n}" for n in range(60_000))
TEXTS = [" ".join(f"t{k}y{n}" for n in range(40)) for k in range(4)]
#: Null and repeated ids, null and empty texts, repeated rows, a long text and its near copy, null sources.
ODD = [
    (1, TEXTS[0], "s"), (1, TEXTS[0], "s"), (1, TEXTS[1], "s"), (2, TEXTS[0].upper(), "s"), (3, TEXTS[0] + " more", None), (None, TEXTS[2], "u"), (None, TEXTS[0], "u"), (None, None, None),
    (4, None, "s"), (5, "", "s"), (6, " \n\t", "u"), (7, "a few words", "u"), (8, LONG, "s"), (9, LONG + " more", "u"), (10, TEXTS[3], "u"), (11, "x" * 100_000, "s"), (12, "é " * 30, None),
]
CLASHES = ("kept", "score", "n_words", "keep_id", "group_size", "component_id", "mix_copy", "mix_key", "rate", "count", "tok", "n", "label", "sequence_id")


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in CLASHES]).repartition(3)


def plain(rows):
    """Rows as comparable tuples; extra columns must be those that the row came with."""
    for r in rows:
        assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for c in CLASHES)
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in rows), key=str)


def test_odd_rows_through_every_stage(spark, sf_dir):
    """Each stage on the whole odd table, not only on what the one before would leave of it."""
    docs, given = odd(spark), sorted(ODD, key=str)
    out = {name: materialise(stage(spark, docs, sf_dir), name) for name, stage in corpus_pipeline.STAGES}
    assert all(out[name].columns == docs.columns for name in list(out)[:-1])
    kept = plain(out["quality_rules"].collect())
    assert all(not stats(t)["base_failed"] for _, t, _ in kept) and {(8, LONG, "s"), (1, TEXTS[0], "s")} <= set(kept)
    assert kept.count((1, TEXTS[0], "s")) == 2
    want, _ = groups([(i, t) for i, t, _ in given])
    kept = plain(out["exact_duplicates"].collect())
    assert sorted((i for i, _, _ in kept), key=str) == sorted([k for _, k in {(h, k) for _, k, _, h in want}], key=str)
    kept = plain(out["near_duplicates"].collect())
    assert Counter(kept) == Counter(r for r in given if r[0] not in (2, 3, 9))
    mixed = plain(out["mixing"].collect())
    assert set(mixed) <= set(given) and all(n % given.count(r) == 0 for r, n in Counter(mixed).items())
    pieces, lengths = out["packing"].collect(), Counter()
    for r in pieces:
        lengths[r["doc_id"]] += r["length"]
    want = Counter()
    for i, t, _ in given:
        want[i] += len(whole(BYTES, t or "")) // 4 + 1
    assert lengths == want
    use = Counter()
    for r in pieces:
        use[r["sequence_id"]] += r["length"]
    assert max(use.values()) <= 2048


def test_empty_tables_through_every_stage(spark, sf_dir):
    docs = odd(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        assert got.count() == 0 and (name == "packing" or got.columns == docs.columns)


def test_registration():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)
