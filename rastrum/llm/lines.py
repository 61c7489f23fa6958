"""Line dedup (operator 1), DataFrame operations only.

A line's spread is the number of distinct sites (sources) it occurs on. Lines on more than one site are found
by a plain aggregation; for them a HyperLogLog sketch of the sites is built per line hash and
merged by aggregation. Where the estimate is within five standard errors of the threshold (3 sites at least), the
sites are counted exactly. Lines that reach ``min_sites`` sites are boilerplate: all their occurrences go but
those in the document with the smallest id, of which the first stays.

Lines are the pieces between line feeds, compared after trimming spaces and tabs; blank lines are kept and never
counted. A common line is joined from a broadcast part of bounded size, the others by shuffle.

Nulls: a null text stays null and has no lines; a null source counts as a site of its own ("");
null ids sort as the largest id. Repeated rows are treated alike (the same lines go or stay). Empty texts and
tables give empty results. Other columns of the input are kept, whatever their names, but for those of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm.frames import LAST_ID, own_names, skew_join, table, written

#: Two hashes of different seeds: lines are told apart by 128 bits.
KEY = ["__hash", "__more"]
LOG_SIZE = 10
ERROR = 1.04 / 2 ** (LOG_SIZE / 2)


def _key(text: str | Column) -> list[Column]:
    trimmed = F.trim(text, F.lit(" \t\r"))
    return [F.xxhash64(trimmed).alias(KEY[0]), F.xxhash64(F.lit(1), trimmed).alias(KEY[1])]


def explode_lines(docs: DataFrame) -> DataFrame:
    """(doc, hash of the text, site, position, line hashes) of every line that isn't blank."""
    lines = docs.where(F.col("text").isNotNull()).select(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("__doc"),
        F.xxhash64("text").alias("__text"),
        F.xxhash64(F.coalesce("source", F.lit(""))).alias("__site"),
        F.posexplode(F.split("text", "\n")).alias("__pos", "__line"),
    )
    return lines.where(F.trim("__line", F.lit(" \t\r")) != "").select("__doc", "__text", "__site", "__pos", *_key("__line"))


def boilerplate(shared: DataFrame, min_sites: int) -> DataFrame:
    """Line hashes (with their counts) that reach ``min_sites`` sites, from lines on more than one site."""
    sketched = shared.groupBy(*KEY).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("__site", F.lit(LOG_SIZE))).alias("__sites"), F.min("__doc").alias("__first"), F.count("*").alias("__count")
    )
    sketched = written(sketched, "sketches")
    near = F.abs(F.col("__sites") - min_sites) <= max(3, 5 * ERROR * min_sites)
    close = sketched.where(near).select(*KEY, "__count")
    pairs = skew_join(shared.select(*KEY, "__site", "__doc", "__pos"), close, KEY, "__count", "left_semi").select(*KEY, "__site").distinct()
    exact = pairs.groupBy(*KEY).agg(F.count("*").alias("__exact")).where(F.col("__exact") >= min_sites).select(*KEY)
    sure = sketched.where(~near & (F.col("__sites") >= min_sites))
    return sure.unionByName(sketched.join(exact, KEY, "left_semi")).select(*KEY, "__first", "__count")


def without(lines: Column, gone: Column) -> Column:
    """``lines`` but for the places in the ascending array ``gone``: the stretches between these, in time linear in the lines."""
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(lines, F.get(edges, k) + 2, F.get(edges, k + 1) - F.get(edges, k) - 1)))


def dedup_lines(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """The rows of ``docs`` with cleaned text, plus n_lines and n_removed (lines that aren't blank)."""
    spread = explode_lines(docs).groupBy(*KEY).agg(F.min("__site").alias("__low"), F.max("__site").alias("__high"), F.count("*").alias("__count"))
    several = written(spread.where("__low <> __high").select(*KEY, "__count"), "several")
    shared = written(skew_join(explode_lines(docs), several, KEY, "__count", "left_semi"), "shared")
    goes = written(boilerplate(shared, min_sites), "boilerplate")
    marked = skew_join(shared.drop("__site"), goes, KEY, "__count")
    removed = marked.groupBy("__doc", "__text", *KEY).agg(F.collect_set("__pos").alias("__at"), F.first("__first").alias("__first"))
    at = F.array_sort("__at")
    removed = removed.select("__doc", "__text", F.explode(F.when(F.col("__doc") == F.col("__first"), F.slice(at, 2, F.size(at))).otherwise(at)).alias("__pos"))
    own_doc, own_text, own_gone = own_names(docs, "__doc", "__text", "__gone")
    removed = removed.groupBy(F.col("__doc").alias(own_doc), F.col("__text").alias(own_text)).agg(F.array_sort(F.collect_list("__pos")).alias(own_gone))
    keyed = docs.withColumns({own_doc: F.coalesce("doc_id", F.lit(LAST_ID)), own_text: F.xxhash64("text")})
    joined = keyed.join(removed, [own_doc, own_text], "left")
    lines = F.split("text", "\n")
    gone = F.col(own_gone)
    filled = F.size(F.filter(lines, lambda line: F.trim(line, F.lit(" \t\r")) != ""))
    return joined.select(
        *[F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")],
        F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(without(lines, gone), "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(filled).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


OP1_SQL = r"""
with lines as (
  select doc_id, coalesce(source, '') as source, unnest(string_split(text, chr(10))) as line,
         unnest(range(len(string_split(text, chr(10))))) as pos
  from (select distinct doc_id, source, text from documents where text is not null)
), filled as (
  select *, trim(line, chr(32) || chr(9) || chr(13)) as k from lines where trim(line, chr(32) || chr(9) || chr(13)) <> ''
), goes as (
  select k, min(doc_id) as first_doc from filled group by k having count(distinct source) >= 10
), ranked as (
  select f.doc_id, f.pos, row_number() over (partition by f.doc_id, f.k order by f.pos) as nth, f.doc_id = g.first_doc as is_first
  from filled f join goes g on f.k = g.k
), gone as (
  select doc_id, pos from ranked where not (is_first and nth = 1)
), cleaned as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null) as text,
         count(*) filter (where g.pos is not null) as n_removed
  from lines l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id
), counts as (select doc_id, count(*) as n_lines from filled group by doc_id)
select d.doc_id, cast(coalesce(c.n_lines, 0) as bigint) as n_lines, cast(coalesce(x.n_removed, 0) as bigint) as n_removed,
       case when d.text is null then null else md5(coalesce(x.text, '')) end as text_md5
from documents d left join cleaned x on d.doc_id = x.doc_id left join counts c on d.doc_id = c.doc_id
"""
