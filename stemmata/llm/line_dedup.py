"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.llm.common import BLANKS, LOWER, UPPER, dropped, numbered, table
from stemmata.runtime import cut

MIN_CHARS, MIN_DOCS = 20, 3
#: Batches that a whole table is taken in, and runs of a level that are merged into one of the next.
BATCHES, FAN_OUT = 4, 2


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


class LineRuns:
    """Runs of (h1, h2, n_docs, last_id), sorted by the key's 128-bit hash: how many documents hold a line, and the largest id of them.

    add() gives each batch a run of its own at level 0; FAN_OUT runs of a level are merged into one of the next level, so that few
    runs are read and each row is rewritten a logarithmic number of times. A run has one row a key however many documents hold it.
    """

    def __init__(self, fan_out: int = FAN_OUT):
        self.fan_out = fan_out
        self.levels: list[list[DataFrame]] = []

    @staticmethod
    def _run(rows: DataFrame) -> DataFrame:
        merged = rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))
        return cut(merged.sortWithinPartitions("h1", "h2"), "run")

    def all(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        out = runs[0] if runs else None
        for r in runs[1:]:
            out = out.unionByName(r)
        return out

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Rows of lines (h1, h2, ...) whose key no run holds: a merge-anti-join with every run."""
        for r in (r for level in self.levels for r in level):
            lines = lines.join(r.select("h1", "h2"), ["h1", "h2"], "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """lines: (h1, h2, first, doc_id), first being true once for each key of a document."""
        self._put(0, self._run(lines.where("first").select("h1", "h2", F.lit(1).cast("long").alias("n_docs"), F.col("doc_id").alias("last_id"))))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            old, self.levels[level] = self.levels[level], []
            merged = old[0]
            for r in old[1:]:
                merged = merged.unionByName(r)
            self._put(level + 1, self._run(merged))
            for r in old:
                dropped(r)

    def compacted(self) -> DataFrame | None:
        """One run of everything."""
        runs = [r for level in self.levels for r in level]
        if len(runs) > 1:
            self.levels = [[self._run(self.all())]]
            for r in runs:
                dropped(r)
        return self.all()


def index_lines(rows: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(nr, doc_id, pos, h1, h2, first) for every line with a key of min_chars or more; rows: those of numbered()."""
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    keys = F.transform(F.split(text, "\n"), lambda line, i: F.struct(line_key(line).alias("key"), i.alias("pos")))
    hashed = F.transform(F.filter(keys, lambda x: F.length(x["key"]) >= min_chars), lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2"), x["pos"].alias("pos")))
    rows = rows.select("nr", F.col("row")[id_col].alias("doc_id"), F.sort_array(hashed).alias("hashed"))
    marked = F.transform(F.col("hashed"), lambda x, k: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), F.coalesce((F.get(F.col("hashed"), k - 1)["h1"] != x["h1"]) | (F.get(F.col("hashed"), k - 1)["h2"] != x["h2"]), F.lit(True)).alias("first")))
    return rows.where(F.size("hashed") > 0).select("nr", "doc_id", F.inline(marked))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs as a struct column `row`, with n_lines, n_dropped and kept_text.

    A key of min_chars code points or more that min_docs documents or more hold loses its lines everywhere but in the largest id
    that holds it. A null or empty text is one empty line. A repeated row counts as one more document; rows that share the largest
    id all keep the line; a null id is smaller than every other. An empty table gives an empty result, and columns may have any
    name. Batches go by a hash of the id; keys are compared by a 128-bit hash.
    """
    rows = numbered(docs)
    lines = cut(index_lines(rows, id_col, text_col, min_chars), "lines")
    runs = LineRuns()
    for b in range(batches):
        runs.add(lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))
    frequent = cut(runs.compacted().where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_id"), "frequent")
    # Both sides are plain exchanges: adaptive execution splits a line that very many documents hold.
    drops = lines.join(frequent, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last_id"))).select("nr", "pos")
    return _without(rows, drops, text_col)


def dedup_batch(runs: LineRuns, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The same columns for a new batch of a growing corpus: lines whose key an earlier batch holds go, by a merge-anti-join of the batch's
    keys with every run; then the batch adds its own run to runs. Within the batch nothing goes.
    """
    rows = numbered(docs)
    lines = cut(index_lines(rows, id_col, text_col, min_chars), "lines")
    fresh = cut(runs.unseen(lines.where("first").select("h1", "h2").distinct()), "fresh")
    drops = lines.join(fresh, ["h1", "h2"], "left_anti").select("nr", "pos")
    out = cut(_without(rows, drops, text_col), "batch")
    runs.add(lines)
    return out


def _without(rows: DataFrame, drops: DataFrame, text_col: str) -> DataFrame:
    """rows (row, nr) as `row`, with n_lines, n_dropped and kept_text, without the lines at drops (nr, pos)."""
    drops = drops.groupBy("nr").agg(F.collect_set("pos").alias("__drop"))
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    out = rows.join(drops, "nr", "left").select("row", F.split(text, "\n").alias("lines"), "__drop", text.alias("whole"))
    kept = let_kept(F.col("lines"), F.col("__drop"))
    return out.select("row", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("__drop").isNull(), F.col("whole")).otherwise(kept).alias("kept_text"))


def let_kept(lines: Column, drop: Column) -> Column:
    """The lines at the positions that drop doesn't hold, joined; linear by the hash set of array_except."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    return F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines() of documents, with a hash of what stays; one row a document, odd rows as there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_sql() -> str:
    return rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{UPPER}', '{LOWER}') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
judged AS (
  SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id <> f.last_id AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
