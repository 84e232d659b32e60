"""Steps over payloads put in a row, with what is known of files joined in.

A step takes a table and returns one, so it also serves ``DataFrame.transform``.
Steps change the column ``payload`` and leave null payloads null. Steps in
Python that follow each other in a chain run in one worker, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import codecs, crypto
from ..functions.rows import by_row
from . import layout

Step = Callable[[DataFrame], DataFrame]

#: What may be said of a file by hand, beside its archive and index.
CONTEXT = "archive string, idx long, path string, compress boolean, data_key binary, meta_key binary, uid long, gid long, mode long, mtime long, expected_sha256 string, edits array<long>, metadata string"


def change(function: Callable[[Column], Column]) -> Step:
    """A step that maps the payload."""
    return lambda df: df.withColumn("payload", function(F.col("payload")))


@dataclass(frozen=True)
class RowStep:
    """A step in Python: a function of a payload that is not null and of further columns. ``into``: a column for its result, a string, where the payload stays."""

    function: Callable
    columns: tuple[Column, ...] = ()
    into: str | None = None
    random: bool = False

    def __call__(self, df: DataFrame) -> DataFrame:
        return together(df, [self])


def together(df: DataFrame, steps: list[RowStep]) -> DataFrame:
    """Put payloads through steps in one worker. The steps' columns are those of ``df``."""
    plan = [(s.function, len(s.columns), s.into) for s in steps]
    names = list(dict.fromkeys(s.into for s in steps if s.into is not None))

    def run(payload, *given):
        at, out = 0, dict.fromkeys(fields)
        for function, n, into in plan:
            value = None if payload is None else function(payload, *given[at : at + n])
            at += n
            if into is None:
                payload = value
            else:
                out[fields[1 + names.index(into)]] = value
        return out | {"payload": payload}

    fields = ["payload", *(f"into{k}" for k in range(len(names)))]
    kind = "struct<payload:binary" + "".join(f",{x}:string" for x in fields[1:]) + ">"
    made = by_row(run, kind, F.col("payload"), *[c for s in steps for c in s.columns], random=any(s.random for s in steps))
    out = df.withColumn("_made", made).withColumn("payload", F.col("_made.payload"))
    for field, name in zip(fields[1:], names, strict=True):
        out = out.withColumn(name, F.col(f"_made.{field}"))
    return out.drop("_made")


def _reads(df: DataFrame, columns: tuple[Column, ...], names: set[str]) -> bool:
    """Whether the columns read any of the names, or can't be told from ``df``."""
    if not columns:
        return False
    try:
        seen = df.select(*[c.alias(f"_{k}") for k, c in enumerate(columns)])._jdf.queryExecution().analyzed().references().toSeq()
    except AnalysisException:
        return True
    return any(seen.apply(k).name().lower() in names for k in range(seen.size()))


def compress() -> Step:
    return RowStep(codecs.zstd_pack)


def decompress() -> Step:
    return RowStep(codecs.zstd_unpack)


def encrypt(key: Column) -> Step:
    """Encrypt each payload with the key of its row; without a key it becomes null."""
    return RowStep(lambda x, k: None if k is None else crypto.encrypt(k, x), (key,), random=True)


def decrypt(key: Column) -> Step:
    """Decrypt each payload with the key of its row; a key that does not fit is an error."""

    def opened(x: bytes, k: bytes | None) -> bytes:
        plain = None if k is None else crypto.decrypt([k], x)
        if plain is None:
            raise ValueError("no key opens a payload")
        return plain

    return RowStep(opened, (key,))


def digest(name: str, into: str) -> Step:
    """Add a column with the payload's digest at this place of the chain."""
    return RowStep(lambda x: hashlib.new(name, x).hexdigest(), into=into)


def cut(first: int, last: int) -> Step:
    return change(lambda x: layout.byte_range(x, first, last))


def edit(edits: Column) -> Step:
    return change(lambda x: layout.edit_list(x, edits))


def unless(skip: Column, step: Step) -> Step:
    """Let rows pass by a step unchanged; a null condition does not skip."""
    if isinstance(step, RowStep):
        passed = (lambda x, *_: x) if step.into is None else (lambda x, *_: None)
        function = step.function
        return RowStep(lambda x, skips, *more: (passed if skips else function)(x, *more), (skip, *step.columns), step.into, step.random)

    def run(df: DataFrame) -> DataFrame:
        passed = F.when(F.coalesce(skip, F.lit(False)), F.col("payload"))
        held = df.withColumn("_passed", passed).withColumn("payload", F.when(F.col("_passed").isNull(), F.col("payload")))
        return step(held).withColumn("payload", F.coalesce("_passed", "payload")).drop("_passed")

    return run


def contexts(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """What is said of files by hand, as a table to attach; names that are no context are an error."""
    schema = StructType.fromDDL(CONTEXT)
    unknown = {k for r in rows for k in r} - set(schema.names)
    if unknown:
        raise ValueError(f"not known of a file: {', '.join(sorted(unknown))}")
    return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)


class Chain:
    """Files with ``archive``, ``idx`` and ``payload``, the steps they go through, and at most one control table."""

    def __init__(self, files: DataFrame):
        self.files, self.steps, self.control = files, [], None

    def add(self, *steps: Step) -> Chain:
        self.steps += steps
        return self

    def attach(self, control: DataFrame) -> Chain:
        """Join a table by archive and idx before the first step; files that it does not name get nulls. A second one is an error, and so is a file named twice."""
        if self.control is not None:
            raise ValueError("a control table is attached already")
        self.control = control
        return self

    def process(self) -> DataFrame:
        df = self.files
        if self.control is not None:
            others = [c for c in self.control.columns if c not in ("archive", "idx")]
            twice = F.raise_error(F.lit("a file is named twice")).cast("long")
            said = self.control.groupBy("archive", "idx").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
            said = said.select(F.col("archive").alias("_a"), F.when(F.col("_n") > 1, twice).otherwise(F.col("idx")).alias("_i"), *others)
            clear = df.drop(*others)
            df = clear.join(said, clear["archive"].eqNullSafe(F.col("_a")) & clear["idx"].eqNullSafe(F.col("_i")), "left").drop("_a", "_i")
        group: list[RowStep] = []
        for step in self.steps:
            changed = {"payload", *(s.into.lower() for s in group if s.into is not None)}
            if group and (not isinstance(step, RowStep) or _reads(df, step.columns, changed)):
                df, group = together(df, group), []
            if isinstance(step, RowStep):
                group.append(step)
            else:
                df = df.transform(step)
        return together(df, group) if group else df
