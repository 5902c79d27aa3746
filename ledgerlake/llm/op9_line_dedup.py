"""Winnowing over line hashes: later repeats of runs of lines are deleted.

A text's lines are its parts between newlines; lines without a word are kept and not counted. The window at a line is the
shortest run of lines from it that has WORDS words or RUN lines, so a passage on one long line is a window of its own. Every window
selects its line with the least hash (rightmost on ties) as a fingerprint, so any two places that share a window share a
fingerprint, at the same distance from the window's start. There is one row per selected position; it knows the windows that
selected it, RUN at most. Positions whose fingerprint occurs once are dropped. The others are joined to the first place
of their fingerprint (in the order of doc_id, then of position) and compared outwards from it: a window matches if all its
lines, before and behind the fingerprint, are those around the first place. A window that does not match there can still
have an earlier copy, but only among windows that do not match either; those few are grouped by their lines, and all
but the first of a group match too. Matched windows that overlap or touch make one run, and the run is deleted from the
later text. So a line goes exactly if it lies in a window that begins earlier elsewhere too; the first occurrence stays whole.

Native DataFrame expressions only. Each position meets its first place alone, never all others, so a line that is everywhere
makes no pairs; fingerprints with a large share of all positions are sent to the rows (``join_listed``). Null texts count
as empty and stay null. Rows with one doc_id and the same text are one text and fare alike; a null doc_id comes first. An empty
table gives an empty result. Other columns of the input pass through ``dedup_lines`` untouched, but for those with the names of
the three counts it adds, which are replaced. Lines are compared by 64-bit hashes, windows by two of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .heavy import join_listed
from .scratch import Scratch

NAME = "op9_line_dedup"
RUN, WORDS = 3, 10
COUNTS = ("n_lines", "n_removed", "n_runs")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _n_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit("[^ \\t\\n\\x0B\\f\\r]+"))


def _worded(line: Column) -> Column:
    return line.rlike("[^ \\t\\n\\x0B\\f\\r]")


def positions(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc_id, mark, fingerprint, spot, windows): the selected lines by their number among worded lines (from 1), with the windows
    (at, n, content) that selected them: first line, number of lines, and a hash of the lines."""
    hashed = F.transform(_lines(F.col("text")), lambda line: F.struct(F.xxhash64(line).alias("h"), _n_words(line).alias("w")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.filter(hashed, lambda x: x["w"] > 0).alias("all")).where(F.size("all") > 0)
    rows = rows.select("doc_id", "mark", F.col("all")["h"].alias("h"), F.col("all")["w"].alias("w"))

    def length(i: Column) -> Column:
        """Of the window at line i; null where the text ends before it."""
        found, total = None, F.lit(0)
        for n in range(1, run):
            total = total + F.coalesce(F.get("w", i + (n - 2)), F.lit(0))
            there = (total >= words) & (i + (n - 1) <= F.size("w"))
            found = F.when(there, n) if found is None else found.when(there, n)
        whole = F.when(i + (run - 1) <= F.size("w"), run)
        return whole if found is None else found.otherwise(whole)

    def window(x: Column) -> Column:
        part = F.slice("h", x["at"], x["n"])
        least = F.array_min(part)
        # Rightmost minimum: the first one of the reversed window.
        spot = x["at"] + (x["n"] - F.array_position(F.reverse(part), least)).cast("int")
        return F.struct(x["at"].alias("at"), x["n"].alias("n"), F.xxhash64(x["n"], part).alias("content"), spot.alias("spot"), least.alias("least"))

    sized = F.transform(F.sequence(F.lit(1), F.size("h")), lambda i: F.struct(i.alias("at"), length(i).alias("n")))
    rows = rows.select("doc_id", "mark", F.transform(F.filter(sized, lambda x: x["n"].isNotNull()), window).alias("all"))
    # Windows begin and end in order, so those that select one line are neighbours.
    same = lambda x: F.filter(F.slice("all", x["k"] + 1, run), lambda y: y["spot"] == x["spot"])
    heads = F.filter(
        F.transform("all", lambda x, k: F.struct(k.alias("k"), x["spot"].alias("spot"), x["least"].alias("fingerprint"))), lambda x: (x["k"] == 0) | (F.get("all", x["k"] - 1)["spot"] != x["spot"])
    )
    kept = F.transform(heads, lambda x: F.struct(x["fingerprint"].alias("fingerprint"), x["spot"].alias("spot"), F.transform(same(x), lambda y: F.struct(y["at"].alias("at"), y["n"].alias("n"), y["content"].alias("content"))).alias("windows")))
    return rows.select("doc_id", "mark", F.explode(kept).alias("x")).select("doc_id", "mark", "x.*")


def later_repeats(docs: DataFrame, scratch: Scratch, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc_id, mark, gone, runs): the numbers among worded lines of those to delete, and how many runs they make; only of texts that lose some."""
    seen = Observation()
    made = scratch.keep(positions(docs, run, words).observe(seen, F.count("*").alias("n")), "positions")
    first = made.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "mark", "spot", "windows")).alias("source"), F.count("*").alias("places")).where("places > 1")
    first = scratch.keep(first, "first-places")
    held = join_listed(made, first, ["fingerprint"], "places", seen.get["n"])
    later = held.where(~F.struct("doc_id", "mark", "spot").eqNullSafe(F.struct("source.doc_id", "source.mark", "source.spot")))
    each = later.select("doc_id", "mark", "fingerprint", "spot", "source", F.explode("windows").alias("x"))
    matched = F.exists("source.windows", lambda y: (y["content"] == F.col("x.content")) & (y["at"] - F.col("source.spot") == F.col("x.at") - F.col("spot")))
    each = scratch.keep(each.select("doc_id", "mark", "fingerprint", "x.*", matched.alias("matched")), "compared")
    scratch.drop(made, first)

    rest, seen = each.where("not matched").drop("matched"), Observation()
    place, content = F.struct("doc_id", "mark", "at"), ["fingerprint", "content"]
    sources = rest.observe(seen, F.count("*").alias("n")).groupBy(*content).agg(F.min(place).alias("source"), F.count("*").alias("places")).where("places > 1")
    sources = scratch.keep(sources, "sources")
    copies = join_listed(rest, sources, content, "places", seen.get["n"]).where(~place.eqNullSafe(F.col("source")))
    gone = each.where("matched").select("doc_id", "mark", "at", "n").unionByName(copies.select("doc_id", "mark", "at", "n")).distinct()

    before = Window.partitionBy("doc_id", "mark").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # A window that begins beyond the line behind all windows before it starts a new run.
    opened = gone.withColumn("opens", F.coalesce(F.col("at") > F.max(F.col("at") + F.col("n")).over(before), F.lit(True)).cast("int"))
    numbers = F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("n") - 1))))
    out = scratch.keep(opened.groupBy("doc_id", "mark").agg(numbers.alias("gone"), F.sum("opens").alias("runs")), "repeats")
    scratch.drop(each, sources)
    return out


def dedup_lines(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """The rows of docs with repeated runs deleted from text, and n_lines, n_removed, n_runs."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    found = later_repeats(docs.select("doc_id", "text"), scratch, run, words)
    # A short list beside all texts: it is the hashed side, and texts are not sorted.
    d, f = docs.alias("d"), found.hint("shuffle_hash").alias("f")
    both = d.join(f, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64("d.text") == F.col("f.mark")), "left")
    lines = _lines(F.col("d.text"))
    worded = F.filter(F.transform(lines, lambda line, i: F.when(_worded(line), i)), lambda i: i.isNotNull())
    # Numbers among worded lines become places in the text.
    places = F.transform("f.gone", lambda g: F.element_at(worded, g))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places), lambda i: F.get(lines, i))
    text = F.when(F.col("f.gone").isNull(), F.col("d.text")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias("text") if c == "text" else F.col(f"d.`{c}`").alias(c) for c in docs.columns if c not in COUNTS]
    counts = (F.size(worded), F.greatest(F.size("f.gone"), F.lit(0)), F.coalesce("f.runs", F.lit(0)))
    return both.select(*columns, *(n.cast("long").alias(c) for c, n in zip(COUNTS, counts, strict=True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", *COUNTS, F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
),
worded AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos
  FROM lines WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')
),
three AS (
  SELECT doc_id, pos, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c, w AS wa, lead(w) OVER o AS wb
  FROM worded WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
),
windows AS (
  SELECT doc_id, pos, a, CASE WHEN wa < 10 THEN b END AS b, CASE WHEN wa < 10 AND wa + wb < 10 THEN c END AS c,
    CASE WHEN wa >= 10 THEN 1 WHEN wa + wb >= 10 THEN 2 WHEN c IS NOT NULL THEN 3 END AS n FROM three
),
ranked AS (
  SELECT doc_id, pos, n, row_number() OVER (PARTITION BY n, a, b, c ORDER BY doc_id, pos) AS nth FROM windows WHERE n IS NOT NULL
),
later AS (
  SELECT doc_id, pos, n, CASE WHEN pos <= max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
  FROM ranked WHERE nth > 1
),
gone AS (SELECT DISTINCT w.doc_id, w.i FROM later l JOIN worded w ON w.doc_id = l.doc_id AND w.pos BETWEEN l.pos AND l.pos + l.n - 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS kept FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
  WHERE g.i IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id,
  (SELECT count(*) FROM worded w WHERE w.doc_id = d.doc_id) AS n_lines,
  (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed,
  CAST(coalesce((SELECT sum(opens) FROM later l WHERE l.doc_id = d.doc_id), 0) AS BIGINT) AS n_runs,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
