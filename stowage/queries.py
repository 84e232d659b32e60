"""Archive queries over the supplied tables, each with the SQL it is held against.

Documents are files of one archive per source. Queries that encode and decode
again are held against SQL on their input. Keys are derived from labels, so
that results repeat; payload columns are read only where they are needed.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import binary as fb
from .functions import borsh, codecs, crypto
from .functions.registry import register
from .functions.rows import by_row, map_rows, unless_null
from .operators import catalog, chain, keys, layout
from .operators.tar import tar_listing, tar_members, tar_volume
from .plans.scratch import new_path
from .sources import archive as arc
from .sources import archive_format as fmt
from .sources import crypt4gh
from .sources.tree import local_path, read_payloads, scan_tree, tree_entries
from .streaming.files import stream_sizes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Files of the supplied documents, in SQL.
FILES = "f AS (SELECT source AS archive, doc_id AS id, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, lang, CAST(strlen(text) AS BIGINT) AS raw_size, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents)"
#: Block size of the queries; supplied payloads are smaller than the format's.
KB = 1024


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.assign_index(catalog.document_files(spark, sf_dir))


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.document_files(spark, sf_dir)


def payload(text: str = "text") -> Column:
    return F.encode(text, "UTF-8")


def hexed(data: Column) -> Column:
    return F.lower(F.hex(data))


def per_row(function, kind: str, *columns: Column) -> Column:
    """A scalar function of binary or string columns; null where one of them is."""
    return by_row(unless_null(function), kind, *columns)


# ---- scans, sizes and digests ------------------------------------------------


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS length FROM documents")
def scan_binary(spark, sf_dir):
    d = raw_files(spark, sf_dir)
    return d.select(F.col("id").alias("doc_id"), F.col("raw_size").alias("length"))


@query("SELECT source AS archive, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def stream_size(spark, sf_dir):
    return stream_sizes(spark, f"{sf_dir}/documents.parquet")


@query("SELECT source AS archive, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def size_probe(spark, sf_dir):
    return raw_files(spark, sf_dir).groupBy("archive").agg(F.sum("raw_size").alias("bytes"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def file_digests(spark, sf_dir):
    d = raw_files(spark, sf_dir)
    return d.select(F.col("id").alias("doc_id"), F.md5(payload()).alias("md5"), F.sha2("text", 256).alias("sha256"))


@query(f"WITH {FILES} SELECT archive, idx // 64 AS volume, sha256(string_agg(text, '' ORDER BY idx)) AS sha256 FROM f GROUP BY archive, idx // 64")
def archive_digest(spark, sf_dir):
    """Digests of volumes of 64 files, hashed piece by piece in order; ``stream_digest`` has those of whole archives."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hashlib.sha256()
        for x in pdf.sort_values("idx").text:
            h.update(x.encode())
        return pd.DataFrame({"archive": pdf.archive.iloc[:1], "volume": pdf.volume.iloc[:1], "sha256": [h.hexdigest()]})

    f = files(spark, sf_dir).withColumn("volume", F.floor(F.col("idx") / 64))
    return f.select("archive", "volume", "idx", "text").groupBy("archive", "volume").applyInPandas(run, "archive string, volume long, sha256 string")


@query(f"WITH {FILES} SELECT archive, count(*) AS n_files, CAST(sum(raw_size) AS BIGINT) AS bytes, sha256(string_agg(text, '' ORDER BY idx)) AS sha256 FROM f GROUP BY archive")
def stream_digest(spark, sf_dir):
    """One digest of the whole stream of every archive: its texts in order through one hash, a batch at a time."""

    def run(batches):
        archive, n, size, h = None, 0, 0, None
        for pdf in batches:
            for name, text in zip(pdf.archive, pdf.text, strict=True):
                if h is None or name != archive:
                    if h is not None:
                        yield pd.DataFrame({"archive": [archive], "n_files": [n], "bytes": [size], "sha256": [h.hexdigest()]})
                    archive, n, size, h = name, 0, 0, hashlib.sha256()
                data = text.encode()
                h.update(data)
                n, size = n + 1, size + len(data)
        if h is not None:
            yield pd.DataFrame({"archive": [archive], "n_files": [n], "bytes": [size], "sha256": [h.hexdigest()]})

    f = raw_files(spark, sf_dir).select("archive", "id", "text")
    return f.repartition("archive").sortWithinPartitions("archive", "id").select("archive", "text").mapInPandas(run, "archive string, n_files long, bytes long, sha256 string")


@query("SELECT doc_id, source AS archive, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, CAST(doc_id AS VARCHAR) || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS raw_size FROM documents")
def file_catalog(spark, sf_dir):
    d = raw_files(spark, sf_dir)
    return d.select(F.col("id").alias("doc_id"), "archive", "path", catalog.base_name(F.col("path")).alias("name"), "raw_size")


@query(
    f"WITH {FILES} SELECT archive, count(*) AS n_files, CAST(sum(raw_size) AS BIGINT) AS raw_bytes, CAST(sum(raw_size + 28 * ((raw_size + 1023) // 1024)) AS BIGINT) AS disk_bytes, CAST(sum(raw_size + 28 * ((raw_size + 1023) // 1024)) AS BIGINT) + 73 AS with_trailer FROM f GROUP BY archive"
)
def archive_sizes(spark, sf_dir):
    d = raw_files(spark, sf_dir).withColumn("disk", layout.encrypted_size(F.col("raw_size"), KB))
    return d.groupBy("archive").agg(F.count(F.lit(1)).alias("n_files"), F.sum("raw_size").alias("raw_bytes"), F.sum("disk").alias("disk_bytes"), (F.sum("disk") + fmt.TRAILER).alias("with_trailer"))


# ---- layout -------------------------------------------------------------------


@query(
    f"WITH {FILES}, s AS (SELECT *, raw_size + 28 * ((raw_size + 1023) // 1024) AS disk_size FROM f) SELECT archive, idx, path, raw_size, CAST(disk_size AS BIGINT) AS disk_size, CAST(sum(disk_size) OVER (PARTITION BY archive ORDER BY idx) - disk_size AS BIGINT) AS file_start, CAST(sum(disk_size) OVER (PARTITION BY archive ORDER BY idx) AS BIGINT) AS file_end, md5(text) AS md5, sha256(text) AS sha256 FROM s"
)
def toc_offsets(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("md5", F.md5(payload())).withColumn("sha256", F.sha2("text", 256)).drop("text")
    out = layout.toc_offsets(f, layout.encrypted_size(F.col("raw_size"), KB))
    return out.select("archive", "idx", "path", "raw_size", "disk_size", "file_start", "file_end", "md5", "sha256")


@query(f"WITH {FILES} SELECT id, archive, idx FROM f")
def assign_idx(spark, sf_dir):
    return files(spark, sf_dir).select("id", "archive", "idx")


@query(
    "SELECT doc_id, CAST(b AS INTEGER) AS block_no, CAST(b * 1024 AS BIGINT) AS raw_offset, CAST(least(1024, strlen(text) - b * 1024) AS BIGINT) AS raw_len, md5(encode(text)[b * 1024 + 1 : b * 1024 + 1024]) AS md5 FROM documents, LATERAL (SELECT unnest(range(0, (strlen(text) + 1023) // 1024)) AS b)"
)
def cipher_blocks(spark, sf_dir):
    b = layout.cut_blocks(raw_files(spark, sf_dir), payload(), KB)
    return b.select(F.col("id").alias("doc_id"), "block_no", "raw_offset", "raw_len", F.md5("bytes").alias("md5"))


@query("SELECT doc_id, CAST(b AS INTEGER) AS frame_no, CAST(least(4096, strlen(text) - b * 4096) AS BIGINT) AS raw_len, CAST((least(4096, strlen(text) - b * 4096) + 1023) // 1024 AS BIGINT) AS n_chunks FROM documents, LATERAL (SELECT unnest(range(0, (strlen(text) + 4095) // 4096)) AS b)")
def zstd_frames(spark, sf_dir):
    """Frames of raw bytes and how many chunks each takes; sizes only, so payloads are not read."""
    d = raw_files(spark, sf_dir).select("id", "raw_size")
    rows = d.select("id", F.posexplode(layout.chunk_sizes(F.col("raw_size"), 4096)).alias("frame_no", "raw_len"))
    return rows.select(F.col("id").alias("doc_id"), "frame_no", "raw_len", layout.block_count(F.col("raw_len"), KB).alias("n_chunks"))


@query("SELECT doc_id, CAST((strlen(text) + 1023) // 1024 AS BIGINT) AS n_chunks, array_to_string(list_transform(range(0, (strlen(text) + 1023) // 1024), lambda b: CAST(least(1024, strlen(text) - b * 1024) AS VARCHAR)), ',') AS sizes FROM documents")
def chunk_index(spark, sf_dir):
    d = raw_files(spark, sf_dir)
    sizes = layout.chunk_sizes(F.col("raw_size"), KB)
    return d.select(F.col("id").alias("doc_id"), F.size(sizes).cast("long").alias("n_chunks"), F.array_join(sizes.cast("array<string>"), ",").alias("sizes"))


_TAR = "512 + raw_size + (512 - raw_size % 512) % 512"


@query(
    f"WITH {FILES} SELECT archive, idx, CAST(sum({_TAR}) OVER (PARTITION BY archive ORDER BY idx) - ({_TAR}) AS BIGINT) AS header_at, CAST(sum({_TAR}) OVER (PARTITION BY archive ORDER BY idx) - ({_TAR}) + 512 AS BIGINT) AS data_at, CAST((512 - raw_size % 512) % 512 AS BIGINT) AS tar_padding, CAST(sum({_TAR}) OVER (PARTITION BY archive ORDER BY idx) AS BIGINT) AS next_at FROM f"
)
def tar_layout(spark, sf_dir):
    return layout.tar_layout(files(spark, sf_dir).drop("text"), F.col("raw_size")).select("archive", "idx", "header_at", "data_at", "tar_padding", "next_at")


@query(
    f"WITH {FILES}, s AS (SELECT archive, idx, (raw_size + 1023) // 1024 AS b, sum((raw_size + 1023) // 1024) OVER (PARTITION BY archive ORDER BY idx) AS e FROM f) SELECT archive, CAST((e - b) // 64 AS BIGINT) AS reader, count(*) AS n_files, CAST(sum(b) AS BIGINT) AS n_blocks FROM s GROUP BY 1, 2"
)
def split_plan(spark, sf_dir):
    blocks = layout.block_count(F.col("raw_size"), KB)
    dealt = layout.split_plan(files(spark, sf_dir).drop("text"), blocks, 64)
    return dealt.groupBy("archive", "reader").agg(F.count(F.lit(1)).alias("n_files"), F.sum(blocks).alias("n_blocks"))


@query("SELECT source AS archive, lang AS part, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source, lang UNION ALL SELECT 'pages', 'html', count(*), CAST(sum(strlen(html)) AS BIGINT) FROM pages")
def concat_inputs(spark, sf_dir):
    docs = raw_files(spark, sf_dir).select("archive", F.col("lang").alias("part"), "raw_size")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("pages").alias("archive"), F.lit("html").alias("part"), F.octet_length("html").cast("long").alias("raw_size"))
    return docs.unionByName(pages).groupBy("archive", "part").agg(F.count(F.lit(1)).alias("n_files"), F.sum("raw_size").alias("bytes"))


# ---- byte filters --------------------------------------------------------------


@query("SELECT doc_id, lower(hex(encode(text)[101:150])) AS bytes FROM documents")
def byte_range(spark, sf_dir):
    return raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), hexed(layout.byte_range(payload(), 100, 150)).alias("bytes"))


@query("SELECT doc_id, lower(hex(encode(text)[11:15] || encode(text)[36:65])) AS bytes FROM documents")
def edit_list(spark, sf_dir):
    edits = F.array(*[F.lit(x) for x in (10, 5, 20, 30)])
    return raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), hexed(layout.edit_list(payload(), edits)).alias("bytes"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lower(hex(encode(text))) ELSE lower(hex(encode(text)[CAST(doc_id % 7 AS BIGINT) + 1 : CAST(doc_id % 7 + doc_id % 11 AS BIGINT)])) END AS bytes FROM documents")
def edit_list_per_file(spark, sf_dir):
    """Every file has its own list; every third none, which keeps it whole."""
    lists = F.when(F.col("id") % 3 != 0, F.array(F.col("id") % 7, F.col("id") % 11))
    return raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), hexed(layout.edit_list(payload(), lists)).alias("bytes"))


@query(
    "WITH r AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n, least(100, strlen(text)) AS a, least(2100, strlen(text)) AS b FROM documents) SELECT doc_id, CAST(a // 1024 * 1052 AS BIGINT) AS disk_from, CAST((b + 1023) // 1024 * 1052 AS BIGINT) AS disk_to, CAST(a % 1024 AS BIGINT) AS discard, CAST(b - a AS BIGINT) AS keep FROM r WHERE b > a"
)
def range_to_blocks(spark, sf_dir):
    d = raw_files(spark, sf_dir)
    first, last = (F.least(F.lit(x), F.col("raw_size")) for x in (100, 2100))
    plan = layout.range_to_blocks(layout.chunk_sizes(F.col("raw_size"), KB), first, last, F.lit(True), F.lit(True), F.col("raw_size"), KB)
    return d.where(last > first).select(F.col("id").alias("doc_id"), plan.alias("p")).select("doc_id", "p.*")


@query("SELECT doc_id, doc_id % 2 = 0 AS skipped, CASE WHEN doc_id % 2 = 0 THEN md5(text) ELSE md5(encode(text)[1:10]) END AS md5 FROM documents")
def skip_bypass(spark, sf_dir):
    """An operator that some rows pass by unchanged."""
    skip = F.col("id") % 2 == 0
    return raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), skip.alias("skipped"), F.md5(F.when(skip, payload()).otherwise(layout.byte_range(payload(), 0, 10))).alias("md5"))


@query("SELECT doc_id, doc_id % 20 < 17 AS framed, true AS packed FROM documents")
def zstd_magic(spark, sf_dir):
    """Texts behind each of the 16 skippable magics and that of a frame, and plain ones."""
    k = F.col("id") % 20
    magic = F.when(k < 16, F.concat(F.lit("5"), F.hex(k), F.lit("2A4D18"))).when(k == 16, F.lit("28B52FFD")).otherwise(F.lit(""))
    d = raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), F.concat(F.unhex(magic), payload()).alias("b"))
    return d.select("doc_id", fb.is_zstd(F.col("b")).alias("framed"), fb.is_zstd(codecs.zstd_compress(F.col("b"))).alias("packed"))


_SPANS = f"{FILES}, s AS (SELECT archive, idx, sum(raw_size) OVER (PARTITION BY archive ORDER BY idx) - raw_size AS lo, sum(raw_size) OVER (PARTITION BY archive ORDER BY idx) AS hi FROM f), p AS (SELECT archive, 5000 * k AS position FROM (SELECT archive, sum(raw_size) AS n FROM f GROUP BY archive), LATERAL (SELECT unnest(range(0, CAST(n // 5000 + 3 AS BIGINT))) AS k))"


def _positions(spark, sf_dir):
    spans = layout.toc_offsets(files(spark, sf_dir).drop("text"), F.col("raw_size"))
    ends = raw_files(spark, sf_dir).groupBy("archive").agg(F.sum("raw_size").alias("n"))
    return spans, ends.select("archive", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 5000) + 2)).alias("k")).select("archive", (F.col("k") * 5000).alias("position"))


@query(f"WITH {_SPANS} SELECT p.archive, CAST(position AS BIGINT) AS position, idx, CAST(position - lo AS BIGINT) AS in_file FROM p JOIN s ON p.archive = s.archive AND position >= lo AND position < hi")
def byte_to_file(spark, sf_dir):
    return layout.file_of_position(*_positions(spark, sf_dir)).select("archive", "position", "idx", "in_file")


@query(f"WITH {_SPANS} SELECT archive, count(*) AS n_discarded FROM p WHERE position >= (SELECT max(hi) FROM s WHERE s.archive = p.archive) GROUP BY archive")
def trailing_discard(spark, sf_dir):
    """Positions past the last file belong to none."""
    spans, positions = _positions(spark, sf_dir)
    inside = layout.file_of_position(spans, positions).select("archive", "position")
    return positions.join(inside, ["archive", "position"], "left_anti").groupBy("archive").agg(F.count(F.lit(1)).alias("n_discarded"))


# ---- catalogue records ---------------------------------------------------------


@query("SELECT doc_id, doc_id % 4 <> 0 AS present, CASE WHEN doc_id % 4 = 1 THEN 1000 END AS uid, CASE WHEN doc_id % 4 = 2 THEN 420 END AS mode FROM documents")
def file_info(spark, sf_dir):
    k = F.col("id") % 4
    none = F.lit(None).cast("long")
    info = catalog.file_info(F.when(k == 1, 1000), none, F.when(k == 2, 420), F.when(k == 3, F.col("id")))
    return raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), info.alias("i")).select("doc_id", F.col("i").isNotNull().alias("present"), "i.uid", "i.mode")


@query("SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id % 2 = 0 THEN md5(text) END AS md5 FROM documents")
def expected_hashes(spark, sf_dir):
    d = raw_files(spark, sf_dir)
    sha, md5 = catalog.expected_hash(F.sha2("text", 256), 32), catalog.expected_hash(F.when(F.col("id") % 2 == 0, F.md5(payload())), 16)
    return d.select(F.col("id").alias("doc_id"), hexed(sha).alias("sha256"), hexed(md5).alias("md5"))


def _key_pair():
    k = F.col("id") % 4
    data = F.when(k > 0, F.sha2(F.concat(F.lit("key-"), F.col("archive")), 256))
    meta = F.when(k == 1, data).when(k == 3, F.sha2(F.concat(F.lit("meta-"), F.col("archive")), 256))
    return data, meta


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'none' WHEN 2 THEN 'data_only' WHEN 3 THEN 'individual' ELSE 'same' END AS policy, array_to_string(CASE doc_id % 5 WHEN 0 THEN [] WHEN 2 THEN ['d'] WHEN 3 THEN ['d', 'm'] WHEN 4 THEN ['m'] ELSE ['d'] END, ',') AS keys FROM documents")
def key_pairs(spark, sf_dir):
    """Policy and keys of every pair of optional keys, a metadata key alone included."""
    k = F.col("id") % 5
    data, meta = F.when(k.isin(1, 2, 3), F.lit("d")), F.when(k == 1, F.lit("d")).when(k.isin(3, 4), F.lit("m"))
    policy = catalog.key_policy(data, meta)
    return raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), policy.alias("policy"), F.array_join(catalog.policy_keys(policy, data, meta), ",").alias("keys"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'same' WHEN 2 THEN 'data_only' ELSE 'individual' END AS policy, doc_id % 4 IN (1, 3) AS record_encrypted, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS n_keys FROM documents")
def key_policy(spark, sf_dir):
    data, meta = _key_pair()
    policy = catalog.key_policy(data, meta)
    d = raw_files(spark, sf_dir).select("id", policy.alias("policy"), F.size(catalog.policy_keys(policy, data, meta)).alias("n_keys"))
    return d.select(F.col("id").alias("doc_id"), "policy", catalog.record_encrypted(F.col("policy")).alias("record_encrypted"), "n_keys")


@query(f"WITH {FILES} SELECT archive, idx, path, raw_size, CAST(raw_size + 28 * ((raw_size + 1023) // 1024) AS BIGINT) AS size_on_disk, sha256(text) AS sha256 FROM f")
def toc_to_context(spark, sf_dir):
    """Stored records as working contexts: digests in hexadecimal, sizes from the offsets."""
    f = files(spark, sf_dir).withColumn("digest", F.unhex(F.sha2("text", 256))).drop("text")
    toc = layout.toc_offsets(f, layout.encrypted_size(F.col("raw_size"), KB))
    return toc.select("archive", "idx", "path", "raw_size", (F.col("file_end") - F.col("file_start")).alias("size_on_disk"), hexed(F.col("digest")).alias("sha256"))


@query("SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS file_path, CAST(strlen(text) AS BIGINT) AS raw_size, doc_id % 2 = 0 AS compressed, doc_id % 4 <> 0 AS encrypted, CAST(1 AS BIGINT) AS block_scale FROM documents")
def context_to_toc(spark, sf_dir):
    data, _ = _key_pair()
    return raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), catalog.relative_path(F.concat(F.lit("/"), F.col("path"))).alias("file_path"), "raw_size", (F.col("id") % 2 == 0).alias("compressed"), data.isNotNull().alias("encrypted"), F.lit(1).cast("long").alias("block_scale"))


@query("SELECT DISTINCT source AS archive, source || '/' || lang AS path FROM documents")
def dir_headers(spark, sf_dir):
    return raw_files(spark, sf_dir).select("archive", F.concat_ws("/", "archive", "lang").alias("path")).distinct()


@query("SELECT source AS archive, 'dir' AS kind, count(DISTINCT lang) AS n FROM documents GROUP BY source UNION ALL SELECT source, 'file', count(*) FROM documents GROUP BY source UNION ALL SELECT source, 'symlink', count(*) FROM (SELECT source, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS r FROM documents) WHERE r > 1 GROUP BY source")
def kind_split(spark, sf_dir):
    d = raw_files(spark, sf_dir)
    folders = dir_headers(spark, sf_dir).select("archive", F.lit("dir").alias("kind"))
    links = _links(spark, sf_dir).select("archive", F.lit("symlink").alias("kind"))
    return folders.union(d.select("archive", F.lit("file"))).union(links).groupBy("archive", "kind").agg(F.count(F.lit(1)).alias("n"))


def _links(spark, sf_dir):
    """Copies within an archive as links to their first file, found by digest."""
    d = raw_files(spark, sf_dir).select("archive", "id", "path", F.sha2("text", 256).alias("digest"))
    first = d.groupBy("archive", "digest").agg(F.min(F.struct("id", "path")).alias("first"))
    return d.join(first, ["archive", "digest"]).where("id <> first.id").select("archive", "id", F.concat("path", F.lit(".link")).alias("path"), F.when(F.col("id") % 5 == 0, F.lit("missing")).otherwise(F.col("first.path")).alias("target"))


_LINKS = f"{FILES}, g AS (SELECT archive, text, min(id) AS first FROM f GROUP BY archive, text), l AS (SELECT f.archive, id, path || '.link' AS path, CASE WHEN id % 5 = 0 THEN 'missing' ELSE f.archive || '/' || CAST(first AS VARCHAR) || '.txt' END AS target FROM f JOIN g ON f.archive = g.archive AND f.text = g.text WHERE id <> first)"


@query(f"WITH {_LINKS} SELECT l.archive, l.path, l.target, f.idx AS target_idx FROM l JOIN f ON l.archive = f.archive AND l.target = f.path")
def symlink_resolve(spark, sf_dir):
    return catalog.resolve_links(files(spark, sf_dir).drop("text"), _links(spark, sf_dir))[0].select("archive", "path", "target", "target_idx")


@query(f"WITH {_LINKS} SELECT archive, path, target FROM l WHERE target = 'missing'")
def symlink_dangling(spark, sf_dir):
    return catalog.resolve_links(files(spark, sf_dir).drop("text"), _links(spark, sf_dir))[1].select("archive", "path", "target")


@query(f"WITH {FILES} SELECT archive, idx, sha256(text) AS sha256 FROM f")
def verify_hashes(spark, sf_dir):
    f = files(spark, sf_dir).select("archive", "idx", F.sha2("text", 256).alias("expected_sha256"))
    digests = files(spark, sf_dir).select("archive", "idx", F.sha2(payload(), 256).alias("sha256"))
    return catalog.verify_digests(f, digests).select("archive", "idx", "sha256")


@query(f"WITH {FILES} SELECT archive, idx, raw_size, CAST(raw_size + 28 * ((raw_size + 1023) // 1024) AS BIGINT) AS disk_size FROM f")
def attach_compression(spark, sf_dir):
    f = files(spark, sf_dir)
    sizes = f.select("archive", "idx", F.octet_length(payload()).cast("long").alias("raw_size")).withColumn("disk_size", layout.encrypted_size(F.col("raw_size"), KB))
    return catalog.attach_sizes(f.select("archive", "idx", "raw_size"), sizes).select("archive", "idx", "raw_size", "disk_size")


@query(f"WITH {FILES} SELECT archive, format('{{:05d}} {{:>10}} {{}}', idx, raw_size, path) AS line FROM f")
def content_list(spark, sf_dir):
    return files(spark, sf_dir).select("archive", F.format_string("%05d %10d %s", "idx", "raw_size", "path").alias("line"))


def _extracted(spark, sf_dir) -> str:
    """The folder to which archives of all documents, in a folder for each language, were extracted."""
    folder = new_path(spark, "extracted")
    by_lang = F.concat_ws("/", "archive", "lang", F.concat(F.col("id").cast("string"), F.lit(".txt")))
    arc.extract_archives(partial(_volumes, spark, sf_dir, path=by_lang), folder, [PRIVATE])
    return folder


_TREE = "source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt'"


@query(f"SELECT {_TREE} AS path, 'file' AS kind, CAST(strlen(text) AS BIGINT) AS raw_size, true AS described FROM documents UNION ALL SELECT DISTINCT source || '/' || lang, 'dir', CAST(0 AS BIGINT), true FROM documents UNION ALL SELECT DISTINCT source, 'dir', CAST(0 AS BIGINT), true FROM documents")
def tree_scan(spark, sf_dir):
    """Files and folders of an extracted tree, as the file system describes them."""
    found = scan_tree(spark, _extracted(spark, sf_dir))
    described = F.col("uid").isNotNull() & F.col("gid").isNotNull() & (F.col("mode") > 0) & (F.col("mtime") > 0)
    return found.select("path", "kind", F.coalesce("raw_size", F.lit(0).cast("long")).alias("raw_size"), described.alias("described"))


@query(f"SELECT {_TREE} AS path, CAST(strlen(text) AS BIGINT) AS raw_size, md5(text) AS md5, true AS owned FROM documents")
def tree_archive(spark, sf_dir):
    """A tree scanned, read and packed into archives with its folders and owners, and their tables of contents."""
    folder = _extracted(spark, sf_dir)
    top = local_path(folder)

    def build(name: str, rows: arc.Rows) -> bytes:
        return fmt.build_archive(read_payloads(arc.entries_of(rows, compress=True), top))

    packed = arc.pack_volumes(tree_entries(scan_tree(spark, folder)), build, size=F.col("raw_size"), then=arc.table_of("files"), schema=arc.SCHEMAS["files"])
    owned = F.col("uid").isNotNull() & F.col("mode").isNotNull() & F.col("mtime").isNotNull()
    return packed.select("path", "raw_size", "md5", owned.alias("owned"))


@query("SELECT source AS archive, lang AS folder, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source, lang")
def extract_list(spark, sf_dir):
    """Files and bytes of every folder of the tree that extraction made: archives are built, extracted to shared storage, and listed from there."""
    folder = _extracted(spark, sf_dir)

    def listed(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for name in pdf.archive:
                found = [x for x in store.get_file_info(fs.FileSelector(f"{top}/{name}", recursive=True)) if x.type == fs.FileType.File and not x.path.endswith(".tmp")]
                yield pd.DataFrame({"archive": [name] * len(found), "folder": [x.path.split("/")[-2] for x in found], "size": [x.size for x in found]})

    made = raw_files(spark, sf_dir).select("archive").distinct().mapInPandas(listed, "archive string, folder string, size long")
    return made.groupBy("archive", "folder").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))


# ---- keys ------------------------------------------------------------------------

_USES = f"{FILES}, u AS (SELECT archive, idx, sha256('key-' || archive || '-' || CAST(idx // 10 AS VARCHAR)) AS key, sha256('reader-' || CAST(r AS VARCHAR)) AS reader FROM f, (SELECT unnest(range(0, 2)) AS r))"


def _uses(spark, sf_dir):
    f = files(spark, sf_dir).select("archive", "idx")
    key = F.sha2(F.concat(F.lit("key-"), "archive", F.lit("-"), F.floor(F.col("idx") / 10).cast("string")), 256)
    return keys.expand_uses(f.withColumn("keys", F.array(key)).withColumn("readers", F.array(*[F.sha2(F.lit(f"reader-{r}"), 256) for r in range(2)])))


@query(f"WITH {_USES} SELECT archive, reader, key, max(idx) AS last_idx FROM u GROUP BY ALL")
def last_use_index(spark, sf_dir):
    return keys.last_use(_uses(spark, sf_dir))


@query(f"WITH {_USES}, k AS (SELECT archive, reader, key, max(idx) AS last_idx FROM u GROUP BY ALL) SELECT archive, reader, key FROM k WHERE last_idx >= 15")
def active_keys(spark, sf_dir):
    """Keys that file 15 or a later one uses."""
    return keys.active(keys.last_use(_uses(spark, sf_dir)), 15).select("archive", "reader", "key")





@query(f"WITH {FILES}, k AS (SELECT archive, 'file' AS kind, idx // 10 AS g, max(idx) AS last_idx FROM f GROUP BY ALL UNION ALL SELECT archive, 'dir', 0, 3 FROM f GROUP BY archive), e AS (SELECT archive, 'file' AS kind, idx FROM f UNION ALL SELECT DISTINCT archive, 'dir', dense_rank() OVER (PARTITION BY archive ORDER BY lang) - 1 FROM f) SELECT e.archive, e.kind, e.idx, count(*) AS n_keys FROM e JOIN k ON e.archive = k.archive AND e.kind = k.kind AND e.idx <= k.last_idx GROUP BY ALL")
def key_entry_join(spark, sf_dir):
    """For every entry the keys of its kind that are still in use, found by a range condition on the last use."""
    f = files(spark, sf_dir)
    held = f.groupBy("archive", F.lit("file").alias("kind"), F.floor(F.col("idx") / 10).alias("g")).agg(F.max("idx").alias("last_idx"))
    held = held.unionByName(f.select("archive").distinct().select("archive", F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("g"), F.lit(3).cast("long").alias("last_idx")))
    folders = f.groupBy("archive").agg(F.sort_array(F.collect_set("lang")).alias("l")).select("archive", F.lit("dir").alias("kind"), F.posexplode("l").alias("idx", "lang")).select("archive", "kind", F.col("idx").cast("long").alias("idx"))
    entries = f.select("archive", F.lit("file").alias("kind"), "idx").unionByName(folders)
    return keys.count_usable(entries, held)


@query(f"WITH {FILES} SELECT archive, sha256('key-' || archive) AS key FROM f GROUP BY archive")
def file_keys(spark, sf_dir):
    """Keys of files, without those of folders."""
    a = raw_files(spark, sf_dir).select("archive").distinct()
    both = a.select("archive", F.lit("file").alias("kind"), F.sha2(F.concat(F.lit("key-"), "archive"), 256).alias("key")).union(a.select("archive", F.lit("dir"), F.sha2(F.concat(F.lit("dir-"), "archive"), 256)))
    return both.where("kind = 'file'").select("archive", "key")


@query("SELECT doc_id, array_to_string(list_filter(CASE doc_id % 3 WHEN 0 THEN ['a', 'b', 'c', 'd'] WHEN 1 THEN ['a', 'b', 'c'] ELSE ['a', 'c', 'b'] END, lambda x: x IS NOT NULL), ',') AS merged FROM documents")
def merge_keys(spark, sf_dir):
    lists = lambda *x: F.array(*[F.lit(v) for v in x])
    k = F.col("id") % 3
    a = F.when(k == 0, lists("a", "c")).when(k == 1, lists("a", "b")).otherwise(lists("a", "c", "b"))
    b = F.when(k == 0, lists("b", "d")).when(k == 1, lists("a", "c")).otherwise(lists("a", "c", "b"))
    return raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), F.array_join(fb.merge_keys(a, b), ",").alias("merged"))


@query(f"WITH {_USES}, k AS (SELECT DISTINCT archive, reader, key FROM u) SELECT archive, count(DISTINCT reader) AS n_packets, CAST(sum(41) + count(DISTINCT reader) * (4 + 32 + 12 + 16) AS BIGINT) AS bytes FROM k GROUP BY archive")
def packet_sizes(spark, sf_dir):
    return keys.packet_sizes(keys.last_use(_uses(spark, sf_dir)))


@query(f"WITH {_USES}, k AS (SELECT DISTINCT archive, reader FROM u) SELECT archive, count(*) + 1 AS n_packets FROM k GROUP BY archive")
def add_reader(spark, sf_dir):
    """Packets of an archive after a reader was added, read back from rewritten footers of whose packets the new one opens."""
    used = _uses(spark, sf_dir).select("archive", "reader").distinct()
    each = used.groupBy("archive").agg(F.count(F.lit(1)).alias("readers"))

    def rewrite(name: str, n: int) -> int:
        private = [arc.key_of(f"private-{k}") for k in range(n + 1)]
        data = fmt.build_archive([{"kind": "file", "path": name, "payload": name.encode(), "data_key": arc.key_of(name), "meta_key": arc.key_of(name)}], [crypto.x25519(p) for p in private[:n]], private[0])
        more = fmt.add_readers(data, [crypto.x25519(private[n])], private[:1])
        footer = fmt.read_footer(more, private[n:])
        assert fmt.check_hash(more) and footer["files"][0]["file_path"] == name
        return len(footer["packets"])

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"archive": pdf.archive, "n_packets": [rewrite(a, n) for a, n in zip(pdf.archive, pdf.readers, strict=True)]})

    return each.mapInPandas(run, "archive string, n_packets long")


@query(f"WITH {FILES} SELECT archive, idx, doc_id % 4 NOT IN (1, 3) AS readable FROM f JOIN documents ON id = doc_id")
def readable_entries(spark, sf_dir):
    data, meta = _key_pair()
    f = files(spark, sf_dir)
    return f.select("archive", "idx", (~catalog.record_encrypted(catalog.key_policy(data, meta))).alias("readable"))


# ---- functions -------------------------------------------------------------------


@query("SELECT doc_id, lower(hex(CAST(concat('\\x5F\\x2A\\x4D\\x18') AS BLOB))) || lower(printf('%02x', doc_id % 50)) || '000000' || repeat('00', CAST(doc_id % 50 AS INTEGER)) AS frame FROM documents")
def skippable_frame(spark, sf_dir):
    return raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), hexed(fb.skippable_frame(F.col("id") % 50 + 8)).alias("frame"))


@query("SELECT doc_id, CASE WHEN doc_id % 300 <= 3 THEN repeat('00', CAST(doc_id % 300 AS INTEGER)) ELSE repeat('00', CAST(doc_id % 300 - 3 AS INTEGER)) || printf('%04x', doc_id % 300) || '00' END AS padding FROM documents")
def padding_bytes(spark, sf_dir):
    return raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), hexed(fb.padding_bytes(F.col("id") % 300)).alias("padding"))


@query("SELECT doc_id, lower(hex(encode(text))) AS encoded, text AS decoded FROM documents")
def hex_codec(spark, sf_dir):
    h = hexed(payload())
    return raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), h.alias("encoded"), F.decode(fb.hex_decode(h), "UTF-8").alias("decoded"))


@query("SELECT doc_id, doc_id | (CAST(1 AS BIGINT) << (doc_id % 20)) AS with_bit, doc_id & ~(CAST(1 AS BIGINT) << (doc_id % 20)) AS without_bit, (doc_id >> (doc_id % 20)) & 1 = 1 AS has_bit FROM documents")
def bit_flags(spark, sf_dir):
    n, bit = F.col("id"), (F.col("id") % 20).cast("int")
    return raw_files(spark, sf_dir).select(n.alias("doc_id"), fb.set_flag(n, bit).alias("with_bit"), fb.clear_flag(n, bit).alias("without_bit"), fb.has_flag(n, bit).alias("has_bit"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'DEBUG' WHEN 1 THEN 'WARN' WHEN 2 THEN 'ERROR' ELSE 'INFO' END AS level FROM documents")
def log_level(spark, sf_dir):
    k = F.col("id") % 4
    name = F.when(k == 0, "debug").when(k == 1, " Warn").when(k == 2, "ERROR").otherwise("loud")
    return raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), fb.log_level(name).alias("level"))


@query("SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, CAST(doc_id AS VARCHAR) || '.txt' AS name FROM documents")
def path_norm(spark, sf_dir):
    p = catalog.relative_path(F.concat(F.lit("//"), F.col("path")))
    return raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), p.alias("path"), catalog.base_name(p).alias("name"))


# ---- codecs ----------------------------------------------------------------------

_MD5 = "SELECT doc_id, md5(text) AS md5 FROM documents"


def _round(spark, sf_dir, there, back):
    """Digests of texts that went there and back, both ways in one worker."""
    d = raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), payload().alias("b"))
    return d.select("doc_id", F.md5(per_row(lambda x: back(there(x)), "binary", F.col("b"))).alias("md5"))


@query(_MD5)
def zstd_roundtrip(spark, sf_dir):
    return _round(spark, sf_dir, codecs.zstd_pack, codecs.zstd_unpack)


@query(_MD5)
def gzip_roundtrip(spark, sf_dir):
    return _round(spark, sf_dir, lambda x: gzip.compress(x, mtime=0), gzip.decompress)


@query()
def compress_probe(spark, sf_dir):
    return raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), codecs.compressible(payload()).alias("compressible"))


@query("SELECT doc_id, CAST(strlen(text) + 28 * ((strlen(text) + 1023) // 1024) AS BIGINT) AS n_bytes FROM documents")
def encrypt_shape(spark, sf_dir):
    d = raw_files(spark, sf_dir)
    sealed = per_row(lambda b: crypto.encrypt(arc.key_of("shape"), b, KB), "binary", payload())
    return d.select(F.col("id").alias("doc_id"), F.octet_length(sealed).cast("long").alias("n_bytes"))


@query(_MD5)
def encrypt_roundtrip(spark, sf_dir):
    key = arc.key_of("k")
    return _round(spark, sf_dir, lambda x: crypto.encrypt(key, x, KB), lambda x: crypto.decrypt([key], x, block=KB))


@query(_MD5)
def multi_key_decrypt(spark, sf_dir):
    """Each block opens with the first of several keys that fits."""
    names = [arc.key_of(f"multi-{k}") for k in range(3)]
    there = lambda x: b"".join(crypto.encrypt(names[k // KB % 3], x[k : k + KB], KB) for k in range(0, len(x), KB))
    return _round(spark, sf_dir, there, lambda x: crypto.decrypt([arc.key_of("wrong"), *names], x, block=KB))


@query(_MD5)
def decrypt_parts(spark, sf_dir):
    """Parts of given lengths, each cut into blocks of its own; sealed and opened in one worker."""
    key = arc.key_of("parts")
    there = lambda x: b"".join(crypto.encrypt(key, x[k : k + 1500], KB) for k in range(0, len(x), 1500))

    def back(x: bytes, raw: int) -> bytes | None:
        sizes = [min(1500, raw - k) for k in range(0, raw, 1500)]
        return crypto.decrypt([key], x, [n + 28 * -(-n // KB) for n in sizes], KB)

    d = raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), payload().alias("b"), "raw_size")
    return d.select("doc_id", F.md5(per_row(lambda x, n: back(there(x), n), "binary", F.col("b"), F.col("raw_size"))).alias("md5"))


@query(_MD5)
def pack_roundtrip(spark, sf_dir):
    """Compression and encryption in one pass, and back."""
    key = arc.key_of("pack")
    return _round(spark, sf_dir, lambda x: fmt.pack_payload(x, key, True)[0], lambda x: fmt.unpack_payload(x, [key], True, True))


@query("SELECT doc_id, doc_id % 3 = 0 AS rotated, md5(text) AS md5 FROM documents")
def key_columns(spark, sf_dir):
    """Every file under a key of its own that is a column, and every third opened only by the key it was changed to."""
    register(spark)
    d = raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), payload().alias("b"), (F.col("id") % 3 == 0).alias("rotated"))
    d = d.withColumn("old", F.unhex(F.sha2(F.concat(F.lit("old-"), F.col("doc_id").cast("string")), 256))).withColumn("new", F.unhex(F.sha2(F.concat(F.lit("new-"), F.col("doc_id").cast("string")), 256)))
    d = d.withColumn("key", F.expr("IF(rotated, new, old)")).withColumn("sealed", F.expr("seal(key, b)"))
    return d.selectExpr("doc_id", "unseal(old, sealed) IS NULL AS rotated", "md5(coalesce(unseal(old, sealed), unseal(new, sealed))) AS md5")


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, sha1(text) AS sha1 FROM documents")
def registered_functions(spark, sf_dir):
    """Digests and codecs called by name from SQL."""
    register(spark)
    d = raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), payload().alias("b"))
    return d.selectExpr("doc_id", "digest('md5', unzstd(zstd(b))) AS md5", "digest('sha256', b) AS sha256", "digest('sha1', b) AS sha1")


# ---- records and archives ----------------------------------------------------------


def _header(path: str, n: int) -> tuple:
    return ("clear", {"file_path": path, "raw_size": n, "file_start": 0, "file_end": n, "compressed": False, "encrypted": False, "block_scale": 1, "index_list": [n], "file_info": {"uid": None, "gid": 7, "mode": 0o644, "mtime": None}, "hashes": None, "metadata": None, "symlinks": None, "custom_ranges": [{"tag": "all", "start": 0, "end": n}]})


_RECORD = "SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS raw_size FROM documents"


def _records(spark, sf_dir, through):
    def run(batches):
        for pdf in batches:
            back = [through(_header(p, n)) for p, n in zip(pdf.path, pdf.raw_size, strict=True)]
            yield pd.DataFrame({"doc_id": pdf.id, "path": [h["file_path"] for h in back], "raw_size": [h["custom_ranges"][0]["end"] for h in back]})

    return raw_files(spark, sf_dir).select("id", "path", "raw_size").mapInPandas(run, "doc_id long, path string, raw_size long")


@query(_RECORD)
def borsh_roundtrip(spark, sf_dir):
    return _records(spark, sf_dir, lambda e: borsh.decode(fmt.FILE_ENTRY, borsh.encode(fmt.FILE_ENTRY, e))[0][1])


@query(_RECORD)
def toc_entry_crypt(spark, sf_dir):
    key = arc.key_of("toc")
    return _records(spark, sf_dir, lambda e: fmt.open_entry(fmt.FILE_ENTRY, fmt.seal_entry(fmt.FILE_ENTRY, e, key), [arc.key_of("no"), key])[1])


@query("SELECT source AS archive, sha256('key-' || source) AS key FROM documents GROUP BY source")
def packet_trial(spark, sf_dir):
    """Three readers' packets per archive, of which one private key opens its own."""
    names = raw_files(spark, sf_dir).select("archive").distinct()

    def opened(name: str) -> str:
        private = [arc.key_of(f"private-{k}") for k in range(3)]
        packets = [fmt.make_packet(crypto.x25519(p), [(arc.key_of(f"key-{name}"), "file", 1)]) for p in private]
        (got,) = [x for x in (fmt.open_packet(p, private[1]) for p in packets) if x is not None]
        return got[0][0].hex()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"archive": pdf.archive, "key": [opened(a) for a in pdf.archive]})

    return names.mapInPandas(run, "archive string, key string")


PRIVATE = arc.key_of("query reader")


def _volumes(spark, sf_dir, encrypted: bool = True, path: Column | str = "path", **more):
    def build(name: str, rows: arc.Rows) -> bytes:
        key = arc.key_of(f"key-{name}") if encrypted else None
        return fmt.build_archive(arc.entries_of(rows, key, key, True), [crypto.x25519(PRIVATE)] if encrypted else [])

    f = files(spark, sf_dir).withColumn("path", F.col(path) if isinstance(path, str) else path).withColumn("payload", payload()).select("archive", "idx", "path", "payload")
    return arc.pack_volumes(f, build, **more)


@query("SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, md5(text) AS md5 FROM documents")
def archive_roundtrip(spark, sf_dir):
    back = arc.archives_from_binary(_volumes(spark, sf_dir), "content", [PRIVATE])
    return back.select("path", F.md5("bytes").alias("md5"))


@query("SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS raw_size, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def archive_toc_roundtrip(spark, sf_dir):
    return arc.archives_from_binary(_volumes(spark, sf_dir), "files", [PRIVATE]).select("path", "raw_size", "sha256", "md5")


_VOLUME = f"WITH {FILES}, v AS (SELECT archive || '-' || CAST(idx // 256 AS VARCHAR) AS archive, raw_size FROM f)"


@query("SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, '{\"lang\":\"' || lang || '\"}' AS metadata, CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 ELSE -1 END AS uid, CAST(CASE WHEN doc_id % 3 > 0 THEN 420 ELSE -1 END AS BIGINT) AS mode FROM documents")
def entry_columns(spark, sf_dir):
    """Columns of the user's own and owners through archives; every third file has no owner (-1)."""
    owned = lambda c: F.when(F.col("id") % 3 > 0, c)
    f = files(spark, sf_dir).select("archive", "idx", "path", payload().alias("payload"), F.to_json(F.struct("lang")).alias("metadata"), owned(F.col("id") % 7).alias("uid"), owned(F.lit(0o644).cast("long")).alias("mode"))
    volumes = arc.pack_volumes(f, lambda name, rows: fmt.build_archive(arc.entries_of(rows)))
    return arc.archives_from_binary(volumes, "files").select("path", "metadata", *[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("uid", "mode")])


@query(f"{_VOLUME} SELECT archive, 1 AS version, CAST(sum(raw_size) AS BIGINT) AS raw_file_size, 1 AS n_packets, true AS sizes_fit FROM v GROUP BY archive")
def archive_eof(spark, sf_dir):
    v = _volumes(spark, sf_dir)
    e = arc.archives_from_binary(v, "eof", [PRIVATE]).join(v.select("archive", F.octet_length("content").cast("long").alias("n")), "archive")
    return e.select("archive", "version", "raw_file_size", "n_packets", (F.col("disk_file_size") == F.col("n")).alias("sizes_fit"))


@query(f"{_VOLUME} SELECT archive, count(*) AS n_files, true AS hash_fits FROM v GROUP BY archive")
def archive_footer(spark, sf_dir):
    def read(name: str, c: bytes):
        yield name, len(fmt.read_footer(c, [PRIVATE])["files"]), fmt.check_hash(c)

    return map_rows(_volumes(spark, sf_dir).select("archive", "content"), read, "archive string, n_files long, hash_fits boolean")


@query(f"{_VOLUME} SELECT archive, 2 AS n_packets, count(*) AS n_files, CAST(sum(raw_size) AS BIGINT) AS raw_bytes, true AS hash_fits FROM v GROUP BY archive")
def footer_rewrite(spark, sf_dir):
    """A reader added to every archive; what it finds in the rewritten footer, opened by its own key alone."""
    other = arc.key_of("second reader")

    def rewritten(name: str, c: bytes):
        more = fmt.add_readers(c, [crypto.x25519(other)], [PRIVATE])
        footer = fmt.read_footer(more, [other])
        found = [h for h in footer["files"] if h is not None]
        yield name, len(footer["packets"]), len(found), sum(h["raw_size"] for h in found), fmt.check_hash(more)

    return map_rows(_volumes(spark, sf_dir).select("archive", "content"), rewritten, "archive string, n_packets int, n_files long, raw_bytes long, hash_fits boolean")


@query("SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, md5(text) AS md5 FROM documents WHERE doc_id % 2 = 0")
def decrypted_entries(spark, sf_dir):
    """Entries of archives under two keys, of which one is known: those that it opens are kept, with their content."""

    def keyed(e: dict) -> dict:
        key = arc.key_of("known" if int(e["path"].rpartition("/")[2][:-4]) % 2 == 0 else "unknown")
        return e | {"data_key": key, "meta_key": key}

    def build(name: str, rows: arc.Rows) -> bytes:
        return fmt.build_archive(map(keyed, arc.entries_of(rows)), [])

    f = files(spark, sf_dir).withColumn("payload", payload()).select("archive", "idx", "path", "payload")
    volumes = arc.pack_volumes(f, build)
    return arc.archives_from_binary(volumes, "content", data_keys=[arc.key_of("known")]).select("path", F.md5("bytes").alias("md5"))


@query(f"{_VOLUME} SELECT archive, count(*) AS n_files FROM v GROUP BY archive")
def footer_extract(spark, sf_dir):
    """The footer found in whatever bytes pass by, with others before and after it."""

    def found(name: str, c: bytes):
        data = b"other bytes " * 9 + c + b" and more" * 20
        at, end, _ = fmt.locate_footer(data)
        yield name, len(fmt.read_footer(data[at:end], [PRIVATE])["files"])

    return map_rows(_volumes(spark, sf_dir).select("archive", "content"), found, "archive string, n_files long")


@query("SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, lower(hex(encode(text)[51:80])) AS bytes FROM documents")
def archive_read_range(spark, sf_dir):
    """A raw byte range of every file, read through its blocks."""

    def ranges(c: bytes):
        footer = fmt.read_footer(c, [PRIVATE])
        ks = [k for k, _, _ in footer["keys"]]
        for h in footer["files"]:
            a, b, skip, keep = fmt.plan_range(h, 50, 80)
            data = c[h["file_start"] + a : h["file_start"] + b]
            yield h["file_path"], fmt.unpack_payload(data, ks, h["compressed"], h["encrypted"])[skip : skip + keep].hex() if keep else ""

    return map_rows(_volumes(spark, sf_dir).select("content"), ranges, "path string, bytes string")


@query(f"WITH {FILES}, s AS (SELECT archive || '-' || CAST(idx // 256 AS VARCHAR) AS archive, idx % 256 AS idx, path, raw_size, idx // 256 AS v, archive AS a FROM f) SELECT archive, idx, path, CAST(sum(raw_size) OVER (PARTITION BY archive ORDER BY idx) - raw_size AS BIGINT) AS file_start, CAST(sum(raw_size) OVER (PARTITION BY archive ORDER BY idx) AS BIGINT) AS file_end FROM s")
def file_slice(spark, sf_dir):
    """Where every file of a plain archive lies, from its table of contents."""

    def build(name: str, rows: arc.Rows) -> bytes:
        return fmt.build_archive(arc.entries_of(rows))

    f = files(spark, sf_dir).withColumn("payload", payload()).select("archive", "idx", "path", "payload")
    return arc.archives_from_binary(arc.pack_volumes(f, build), "files").select("archive", "idx", "path", "file_start", "file_end")


@query("SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS raw_size FROM documents")
def tar_roundtrip(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("payload", payload()).select("archive", "idx", "path", "payload")
    return tar_members(arc.pack_volumes(f, tar_volume))


@query("SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS raw_size FROM documents")
def tar_gzip_roundtrip(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("payload", payload()).select("archive", "idx", "path", "payload")
    return tar_members(arc.pack_volumes(f, lambda name, rows: gzip.compress(tar_volume(name, rows), mtime=0)))


_FIRST = "SELECT source AS archive, min(doc_id) AS id FROM documents GROUP BY source"


@query(
    f"SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, 'file' AS kind, CAST(strlen(text) AS BIGINT) AS raw_size, CAST(NULL AS VARCHAR) AS target, CAST(420 AS BIGINT) AS mode FROM documents UNION ALL SELECT archive, 'dir', CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(493 AS BIGINT) FROM ({_FIRST}) UNION ALL SELECT archive || '/first', 'symlink', CAST(0 AS BIGINT), archive || '/' || CAST(id AS VARCHAR) || '.txt', CAST(420 AS BIGINT) FROM ({_FIRST})"
)
def tar_tree(spark, sf_dir):
    """Folders, files and links through TAR volumes."""
    f = files(spark, sf_dir).select("archive", "idx", "path", payload().alias("payload"), F.lit("file").alias("kind"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("long").alias("mode"))
    head = f.where("idx = 0").drop("payload").withColumn("payload", F.lit(None).cast("binary"))
    folders = head.withColumn("path", F.col("archive")).withColumn("kind", F.lit("dir")).withColumn("mode", F.lit(0o755).cast("long"))
    links = head.withColumn("target", F.col("path")).withColumn("path", F.concat("archive", F.lit("/first"))).withColumn("kind", F.lit("symlink"))
    volumes = arc.pack_volumes(f.unionByName(folders).unionByName(links), tar_volume)
    return tar_listing(volumes).select("path", "kind", "raw_size", "target", "mode")


@query(f"WITH {FILES} SELECT path, sha256(text) AS before, CASE WHEN idx % 3 = 0 THEN md5(encode(text)[6:25]) ELSE md5(text) END AS after FROM f")
def transform_chain(spark, sf_dir):
    """Payloads through a chain of steps and back, with keys and edit lists from a table that is attached; every fourth file passes by the cipher."""
    f = files(spark, sf_dir).select("archive", "idx", "path", payload().alias("payload"))
    edits = F.when(F.col("idx") % 3 == 0, F.array(F.lit(5).cast("long"), F.lit(20).cast("long")))
    control = f.select("archive", "idx", F.unhex(F.sha2(F.col("path"), 256)).alias("data_key"), edits.alias("edits"))
    skip, key = F.col("idx") % 4 == 0, F.col("data_key")
    steps = (chain.digest("sha256", "before"), chain.compress(), chain.unless(skip, chain.encrypt(key)), chain.unless(skip, chain.decrypt(key)), chain.decompress(), chain.edit(F.col("edits")))
    return chain.Chain(f).attach(control).add(*steps).process().select("path", "before", F.md5("payload").alias("after"))


# ---- keys in files and Crypt4GH ------------------------------------------------------


def _small(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _archive_keys(spark, sf_dir, columns: list[str], one) -> DataFrame:
    """Rows that ``one`` makes of every archive's name and its key, the digest of the name."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(a, *one(a, arc.key_of(a))) for a in pdf.archive], columns=["archive", *columns])

    names = raw_files(spark, sf_dir).select("archive").distinct()
    return names.mapInPandas(run, ", ".join(f"{c} string" for c in ["archive", *columns]))


@query("SELECT DISTINCT source AS archive, to_base64(unhex('302e020100300506032b656e04220420' || sha256(source))) AS body, sha256(source) AS key FROM documents")
def pem_key(spark, sf_dir):
    """A private key in PEM for every archive, by the public structure for X25519 keys, and read back."""

    def one(name: str, key: bytes) -> tuple:
        pem = crypt4gh.write_pem(key)
        return "".join(pem.strip().splitlines()[1:-1]), crypt4gh.read_pem(pem).hex()

    return _archive_keys(spark, sf_dir, ["body", "key"], one)


@query("SELECT DISTINCT source AS archive, 'true' AS fits, '32' AS n_bytes, 'true' AS fresh FROM documents")
def key_generation(spark, sf_dir):
    """A new key pair and a new archive key for every archive: the public key fits the private one, and none comes twice."""

    def one(name: str, key: bytes) -> tuple:
        private, public = (crypt4gh.read_pem(x) for x in crypt4gh.new_key_pair())
        keys = {private, public, fmt.new_key(), fmt.new_key()}
        return str(crypto.x25519(private) == public).lower(), str(min(map(len, keys))), str(len(keys) == 4).lower()

    return _archive_keys(spark, sf_dir, ["fits", "n_bytes", "fresh"], one)


@query("SELECT DISTINCT source AS archive, to_base64(unhex('633467682d7631' || '0004' || '6e6f6e65' || '0004' || '6e6f6e65' || '0020' || sha256(source))) AS body, sha256(source) AS open, sha256(source) AS locked FROM documents")
def c4gh_key_parse(spark, sf_dir):
    """A Crypt4GH key file for every archive, by the public specification, read without and with a phrase."""

    def one(name: str, key: bytes) -> tuple:
        plain, phrase = crypt4gh.write_key(key), name.encode()
        return "".join(plain.strip().splitlines()[1:-1]), crypt4gh.read_key(plain).hex(), crypt4gh.read_key(crypt4gh.write_key(key, phrase), phrase).hex()

    return _archive_keys(spark, sf_dir, ["body", "open", "locked"], one)


@query("SELECT source AS archive, 1 AS version, 2 AS n_packets, true AS opened, '6372797074346768' || '01000000' || '02000000' || '6c000000' AS head, CAST(16 + 2 * 108 AS BIGINT) AS n_bytes FROM documents GROUP BY source")
def c4gh_header(spark, sf_dir):
    names = raw_files(spark, sf_dir).select("archive").distinct()

    def one(name: str) -> tuple:
        private = [arc.key_of("r1"), arc.key_of("r2")]
        head = crypt4gh.write_header(arc.key_of(name), [crypto.x25519(p) for p in private], arc.key_of("w"))
        version, packets, _ = crypt4gh.read_header(head)
        return version, len(packets), all(crypt4gh.open_header(head, p) == [arc.key_of(name)] for p in private), head[:20].hex(), len(head)

    def run(batches):
        for pdf in batches:
            got = [one(a) for a in pdf.archive]
            columns = ["version", "n_packets", "opened", "head", "n_bytes"]
            yield pd.DataFrame({"archive": pdf.archive} | {c: [g[n] for g in got] for n, c in enumerate(columns)})

    return names.mapInPandas(run, "archive string, version int, n_packets int, opened boolean, head string, n_bytes long")


@query("SELECT doc_id, CAST(40 * (doc_id % 5) + 16 + 8 * (doc_id % 9) AS BIGINT) AS n_bytes FROM documents")
def c4gh_packet_len(spark, sf_dir):
    """Bytes of a header's packets: 40 for each key, 8 + 8 for an edit list and 8 for each of its lengths."""
    edits = F.sequence(F.lit(1), F.col("id") % 9)
    n = F.when(F.col("id") % 9 > 0, F.aggregate(edits, F.lit(0).cast("long"), lambda a, _: a + 8)).otherwise(F.lit(0))
    return raw_files(spark, sf_dir).select(F.col("id").alias("doc_id"), (40 * (F.col("id") % 5) + 16 + n).cast("long").alias("n_bytes"))


@query("SELECT 'rfc7914' AS name, true AS equal, 32 AS n")
def scrypt_vector(spark, sf_dir):
    want = bytes.fromhex("7023bdcb3afd7348461c06cd81fd38eb")
    same = hashlib.scrypt(b"pleaseletmein", salt=b"SodiumChloride", n=16384, r=8, p=1, dklen=64)[:16] == want
    key = crypto.scrypt_key(b"pleaseletmein", b"SodiumChloride")
    return _small(spark, [("rfc7914", same and key[:16] == want, len(key))], "name string, equal boolean, n int")
