"""Personal data by weak supervision.

Base rules find e-mail addresses, IP numbers, card numbers and telephone
numbers. Beside them, candidate spans (identifier-like tokens with a digit)
are judged for credentials: regular expressions, a gazetteer of key words and
the context vote for, against or abstain; expectation-maximisation over the
vote patterns of all documents estimates how reliable each labeler is and the
probability of every pattern; a naive Bayes span classifier is then trained on
span features with these probabilities and decides. Candidates that touch a
base span are left to the base rules.

The corpus is reduced to counts of (votes, features), of which there are at
most 3^labelers times the number of feature values, before anything reaches
the driver. Positions are running sums over the pieces between matches and the
matches, so all stays in built-in functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Possessive forms of the rules: the same matches, without backtracking over
#: long runs. A run is entered at its start or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An identifier-like token of 8 characters or more with a digit.
TOKEN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{8,}+"
CONTEXT = 24
#: Gazetteer of words that introduce credentials.
KEY_WORDS = ("password", "passwd", "passphrase", "pwd", "token", "secret", "credential", "apikey", "api_key", "api-key", "access_key", "private_key", "auth")
KINDS = ("email", "ip", "card", "phone")
ADDED = "secret"
LABELERS = ("format", "numeric", "key_word", "assigned", "plain_context")
#: A span is added from this probability on.
SURE = 0.9


def running_sums(lengths: Column, block: int = 256) -> Column:
    """Sums of all earlier elements, in blocks so that long arrays are not copied once per element."""
    sums = lambda a: F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(acc[F.size(acc) - 1] + x)))
    last = lambda a: a[F.size(a) - 1]

    def joined(parts: Column) -> Column:
        bases = sums(F.transform(parts, last))
        return let(bases, lambda b: F.flatten(F.transform(parts, lambda p, i: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x + b[i]))))

    def blocks(a: Column) -> Column:
        n = F.ceil(F.size(a) / block).cast("int")
        cut = F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: sums(F.slice(a, i * block + 1, F.lit(block))))).otherwise(F.array().cast("array<array<int>>"))
        return let(cut, joined)

    return let(lengths, blocks)


def matches(text: Column, regex: str) -> Column:
    """All leftmost, non-overlapping matches as structs of s (start), e (end, exclusive) and m (the match), in code points."""

    def placed(hits: Column) -> Column:
        lengths = F.zip_with(F.split(text, regex, -1), hits, lambda piece, hit: F.struct(F.char_length(piece).alias("p"), F.coalesce(F.char_length(hit), F.lit(0)).alias("h")))
        return let(lengths, lambda k: let(running_sums(F.transform(k, lambda x: x["p"] + x["h"])), lambda before: F.transform(hits, lambda m, i: F.struct((before[i] + k[i]["p"]).alias("s"), (before[i] + k[i]["p"] + k[i]["h"]).alias("e"), m.alias("m")))))

    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.char_length(d)

    def digit(i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, F.lit(2)).otherwise(F.lit(1))
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of every kind, as arrays of structs s, e, m."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    digit = text.rlike("[0-9]")
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    length = lambda x: F.char_length(_digits(x["m"]))
    return {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(none),
        "ip": F.when(digit, F.filter(matches(text, IP), lambda x: x["m"].rlike(rf"^{byte}(?:\.{byte}){{3}}$"))).otherwise(none),
        "card": F.when(digit, F.filter(matches(text, CARD), lambda x: F.when(length(x).between(16, 19), _luhn(_digits(x["m"]))).otherwise(F.lit(False)))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda x: length(x).between(8, 15))).otherwise(none),
    }


def _candidates(text: Column, base: Column) -> Column:
    """Tokens that touch no base span, with the text before them."""
    free = F.filter(matches(text, TOKEN), lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (b["e"] > c["s"])))
    start = lambda c: F.greatest(c["s"] - CONTEXT, F.lit(0))
    return F.transform(free, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("m"), F.substring(text, start(c) + 1, c["s"] - start(c)).alias("b")))


def _votes(c: Column) -> Column:
    """One character per labeler: + for a credential, - against, 0 abstains."""
    m, before = c["m"], F.lower(c["b"])
    vote = lambda yes, no: F.when(yes, F.lit("+")).when(no, F.lit("-")).otherwise(F.lit("0"))
    no = F.lit(False)
    mixed = m.rlike("[A-Za-z]") & m.rlike("[0-9]")
    return F.concat(
        vote(m.rlike("^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{16,}|(?:sk|pk|ghp|xox[a-z])[-_][A-Za-z0-9_-]{16,})$") & mixed, F.char_length(m) < 12),
        vote(no, m.rlike("^[0-9_+/-]+$")),
        vote(before.rlike("(?:" + "|".join(KEY_WORDS) + r")[\x20\x09\"':=]*$"), no),
        vote(before.rlike(r"[=:][\x20\x09]?[\"']?$"), no),
        vote(no, before.rlike(r"[a-z]{2,}[,.]?\x20$") & ~mixed),
    )


def _features(c: Column) -> Column:
    """What the final classifier sees of a span: five discrete features in one string."""
    m = c["m"]
    share = F.char_length(_digits(m)) * 4 / F.char_length(m)
    return F.concat_ws(
        "|",
        F.when(F.char_length(m) < 12, "a").when(F.char_length(m) < 16, "b").when(F.char_length(m) < 24, "c").otherwise("d"),
        F.floor(share).cast("string"),
        F.when(m.rlike("^[0-9a-f]+$"), "x").when(m.rlike("^[A-Z0-9]+$"), "u").when(m.rlike("^[A-Za-z0-9]+$"), "m").otherwise("o"),
        F.when(m.rlike("^[0-9_+/-]+$"), "n").otherwise("y"),
        F.when(c["b"].rlike(r"[=:][\x20\x09]?[\"']?$"), "=").when(c["b"].rlike(r"[A-Za-z,.]\x20$"), "w").otherwise("o"),
    )


def fit_labelers(patterns: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], list[dict[str, dict[str, float]]]]:
    """Expectation-maximisation over vote patterns: P(credential | pattern) and each labeler's vote probabilities by class.

    Starts from the votes' majority, smooths with one pseudo-count, and runs
    a fixed number of rounds, so the result is a function of the counts.
    """
    if not patterns:
        return {}, []
    score = lambda p: (p.count("+") + 0.5) / (p.count("+") + p.count("-") + 1)
    post = {p: 0.9 if score(p) > 0.5 else 0.1 for p in patterns}
    tables: list[dict[str, dict[str, float]]] = []
    for _ in range(rounds):
        mass = {"1": sum(n * post[p] for p, n in patterns.items()), "0": sum(n * (1 - post[p]) for p, n in patterns.items())}
        tables = []
        for k in range(len(next(iter(patterns)))):
            own = {}
            for y in "10":
                seen = {v: 1 / 3 + sum(n * (post[p] if y == "1" else 1 - post[p]) for p, n in patterns.items() if p[k] == v) for v in "+-0"}
                own[y] = {v: x / (mass[y] + 1) for v, x in seen.items()}
            tables.append(own)
        prior = (mass["1"] + 1) / (mass["1"] + mass["0"] + 2)
        for p in patterns:
            odds = math.log(prior) - math.log1p(-prior) + sum(math.log(t["1"][v]) - math.log(t["0"][v]) for t, v in zip(tables, p, strict=True))
            post[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    # A labeler that votes for may not count against: keep the class called 1 the one the votes are for.
    return post, tables


def fit_classifier(cells: list[tuple[str, str, int]], post: dict[str, float]) -> tuple[float, list[dict[str, float]]]:
    """Naive Bayes on soft labels: the prior's log-odds and one table of log-odds for each feature."""
    mass = {1: 1.0, 0: 1.0}
    seen: list[dict[str, dict[int, float]]] = []
    for votes, features, n in cells:
        parts = features.split("|")
        seen = seen or [{} for _ in parts]
        mass[1] += n * post[votes]
        mass[0] += n * (1 - post[votes])
        for t, v in zip(seen, parts, strict=True):
            cell = t.setdefault(v, {1: 0.5, 0: 0.5})
            cell[1] += n * post[votes]
            cell[0] += n * (1 - post[votes])
    return math.log(mass[1] / mass[0]), [{v: math.log(c[1] / mass[1]) - math.log(c[0] / mass[0]) for v, c in sorted(t.items())} for t in seen]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """Spans of personal data in whole texts, one row per input row.

    Returns ``id_col``, the arrays ``email, ip, card, phone, secret`` of
    structs ``s`` (start), ``e`` (end, exclusive; code points) and ``m`` (the
    matched text). Other columns are left out, whatever their names. A null
    text counts as empty and has no spans; texts of any length are searched
    whole; texts without candidates train nothing and get none; repeated rows
    give repeated results; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_x2_text"))
    rows = rows.select("*", *[c.alias(f"_x2_{k}") for k, c in base_spans(F.col("_x2_text")).items()])
    base = F.concat(*[F.col(f"_x2_{k}") for k in KINDS])
    found = F.when(F.col("_x2_text").rlike("[0-9]"), _candidates(F.col("_x2_text"), base)).otherwise(F.array().cast("array<struct<s:int,e:int,m:string,b:string>>"))
    rows = rows.withColumn("_x2_c", found)
    cells = [
        (r["v"], r["f"], r["n"])
        for r in rows.select(F.explode("_x2_c").alias("c")).groupBy(_votes(F.col("c")).alias("v"), _features(F.col("c")).alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
    ]
    cells.sort()
    patterns: dict[str, int] = {}
    for v, _, n in cells:
        patterns[v] = patterns.get(v, 0) + n
    post, _ = fit_labelers(patterns)
    prior, tables = fit_classifier(cells, post)
    # The classifier over its discrete inputs, written out as the set of those it accepts.
    accepted = [f for f in sorted({f for _, f, _ in cells}) if prior + sum(t[v] for t, v in zip(tables, f.split("|"), strict=True)) >= math.log(sure / (1 - sure))]
    added = F.filter("_x2_c", lambda c: _features(c).isin(accepted)) if accepted else F.filter("_x2_c", lambda c: F.lit(False))
    return rows.select(id_col, *[F.col(f"_x2_{k}").alias(k) for k in KINDS], F.transform(added, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("m"))).alias(ADDED))


def span_text(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.concat(*[span_text(k, F.col(k)) for k in KINDS])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, ADDED)]
    flagged = sum((F.size(k) for k in (*KINDS, ADDED)), F.lit(0)) > 0
    return found.select("doc_id", *counts, flagged.alias("has_pii"), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, span_text(ADDED, F.col(ADDED))), ",").alias("spans"))
