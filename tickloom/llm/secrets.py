"""Secret scans: patterns, and how widely each value is owned.

Patterns find candidate values in every text.  Over the whole corpus the hash
of each value is aggregated to the number of distinct repositories and owners
that hold it, copies of one text counting once.  A value that many hold has been
copied around (a documented example, a test key, a published fingerprint); one
that few hold and that looks like a real credential is taken for live.

Long mixed strings without a keyword are too common to be called secrets on
sight: such a candidate becomes a span of its own only if it is live.

Matches become rows, and places in the text running sums over them: the work
follows the number of matches, however many a text has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, saved, table

#: Kinds in their order, with pattern, the group that holds the value, and its least length (fixed values).
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # runs of 32 and more: shorter ones would be dropped anyway
)
#: Candidates that the method adds if they are live.
OWNED = ("owned", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}", 0, 24)

#: A value that more owners than this hold is a copied example, and so is one that more repositories hold
#: of which none, or more than one, is known to be its owner's.
MOST_OWNERS, MOST_REPOS = 2, 3
#: Values that do not look like a real credential: placeholders, or too few different characters.
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|your|test|xxxx|0000|1234567"
LEAST_VARIETY = 8

#: Marks up to which a text is cut mark by mark.
FEW = 32


def matches_of(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """All matches of a pattern in order, as structs (rank, kind, gap, size, value), if a value is long enough.

    gap is the number of code points between a match and the one before it,
    size its own; value is NULL where it is too short to count.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("match"))

    def described(pair):
        value = F.regexp_extract(pair["match"], pattern, group) if group else pair["match"]
        return F.struct(
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            pair["gap"].alias("gap"),
            F.length(pair["match"]).alias("size"),
            F.when(F.length(value) >= least, value).alias("value"),
        )

    none = F.array().cast("array<struct<rank:int,kind:string,gap:int,size:int,value:string>>")
    # most texts have no match: one look decides
    return F.when(text.rlike(pattern), F.transform(pairs, described)).otherwise(none)


def looks_real(value: Column) -> Column:
    """Letters and digits, enough different characters, no placeholder."""
    variety = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (variety >= LEAST_VARIETY) & ~value.rlike(PLACEHOLDER)


def is_live(real: Column, n_owners: Column, n_repos: Column) -> Column:
    """Whether a value that looks real is held by few: by one owner, by two, or by few repositories without a known owner."""
    return real & (n_owners <= MOST_OWNERS) & ((n_owners == 1) | (n_repos <= MOST_REPOS))


def find_spans(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str, copies_once: bool = True) -> tuple[DataFrame, DataFrame]:
    """The spans that count, and how often each (id, text) occurs; both without texts.

    Spans: (row, id, print, start, rank, end, kind, live, n_repos, n_owners), one for each span of each row of
    docs; copies: (id, print, copies).  print is a hash of the text.  Texts are read once; all candidates are
    written, with hashes for values.
    """
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        column(id_col).alias("id"),
        text.alias("text"),
        column(owner_col).cast("string").alias("owner"),
        column(repo_col).cast("string").alias("repo"),
        F.monotonically_increasing_id().alias("row"),
    )
    found = F.concat(*(matches_of(F.col("text"), kind, k, *rest) for k, (kind, *rest) in enumerate((*BASE, OWNED))))
    print_ = F.xxhash64("text", F.length("text")).alias("print")
    # first what takes the text, once for each; then a row for each match
    rows = rows.select("row", "id", print_, "owner", "repo", found.alias("found"))
    rows = rows.select("row", "id", "print", "owner", "repo", F.posexplode_outer("found").alias("pos", "m"))
    value = F.col("m.value")
    rows = saved(
        rows.select(
            "row", "id", "print", "owner", "repo", "pos", "m.rank", "m.kind", "m.gap", "m.size",
            F.sha2(value.cast("binary"), 256).alias("value"), looks_real(value).alias("real"),
        ),
        "secret-candidates",
    )
    first = F.coalesce("pos", F.lit(0)) == 0
    copies = rows.filter(first).groupBy("id", "print").agg(F.count("*").alias("copies"))
    held = rows.filter("value IS NOT NULL")
    # two steps: a value copied into many rows shrinks before it is counted
    if copies_once:  # whoever holds copies of a text, it counts for one of them
        by_repo = held.groupBy("value", "print").agg(F.min("owner").alias("owner"), F.min("repo").alias("repo"))
    else:
        by_repo = held.select("value", "owner", "repo").distinct()
    owned = by_repo.groupBy("value").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("repo").alias("n_repos"))
    owned = saved(owned, "secret-owners")
    # places: the sums of what lies before, also of matches that do not count
    upto = Window.partitionBy("row", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.filter("pos IS NOT NULL").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int"))
    placed = placed.filter("value IS NOT NULL").withColumn("start", F.col("end") - F.col("size"))
    placed = saved(placed.select("row", "id", "print", "start", "rank", "end", "kind", "value", "real"), "secret-places")
    # both sides are plain tables here, so that AQE splits a value that many rows share
    judged = placed.join(owned, "value").withColumn("live", is_live(F.col("real"), F.col("n_owners"), F.col("n_repos")))
    # an added span lies apart from all base spans: none that begins before it reaches into it, none begins within it
    base = F.col("rank") < len(BASE)
    forth = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    judged = judged.withColumns(
        {"reach": F.max(F.when(base, F.col("end"))).over(forth), "next": F.min(F.when(base, F.col("start"))).over(back)}
    )
    apart = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    judged = judged.filter(base | F.col("live") & apart)
    return judged.select("row", "id", "print", "start", "rank", "end", "kind", "live", "n_repos", "n_owners"), copies


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    copies_once: bool = True,
) -> DataFrame:
    """(id, print, copies, spans) of every different (id, text); print is a hash of the text, copies how often the row occurs.

    spans: array of (start, rank, end, kind, live, n_repos, n_owners) by start,
    then kind; start and end count code points, end exclusive.  A NULL text
    counts as empty and has no spans.  A NULL owner or repository counts as
    none; a value that only rows without an owner hold is live as long as few
    repositories hold it.  Equal texts count for one owner and one repository,
    so that a document crawled under two owners does not turn its own credential
    into a copied example, unless copies_once is false.  Rows without an id are
    scanned like any other.
    """
    found, copies = find_spans(docs, id_col, text_col, owner_col, repo_col, copies_once)
    span = F.struct("start", "rank", "end", "kind", "live", "n_repos", "n_owners")
    spans = found.groupBy("id", "print").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    spans = spans.withColumnsRenamed({"id": "of_id", "print": "of_print"})
    rows = copies.join(spans, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("print") == F.col("of_print")), "left")
    none = F.array().cast(spans.schema["spans"].dataType)
    return rows.select("id", "print", "copies", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    mark: str = "[SECRET]",
    copies_once: bool = True,
) -> DataFrame:
    """All rows and columns of docs, live secrets in the text replaced by a mark; copied examples stay.

    copies_once is that of scan_secrets.
    Spans that overlap become one mark.  A text without live secrets stays as
    it is, NULL too.
    """
    found, _ = find_spans(docs, id_col, text_col, owner_col, repo_col, copies_once)
    live = found.filter("live").select("id", "print", "start", "end").distinct()
    # what is kept before each mark: from the furthest end so far to the start
    before = Window.partitionBy("id", "print").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumn("at", F.coalesce(F.max("end").over(before), F.lit(0)))
    # few texts hold live secrets: their spans are a small table, whose size decides how it is joined
    kept = F.when(F.col("start") >= F.col("at"), F.struct("start", "at"))
    hits = live.groupBy(F.col("id").alias("__id"), F.col("print").alias("__print")).agg(
        F.array_sort(F.collect_list(kept)).alias("__kept"), F.max("end").alias("__tail")
    )
    hits = saved(hits, "secret-live")
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    marked = docs.withColumn("__own", F.xxhash64(text, F.length(text)))
    rows = marked.join(hits, column(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__print")), "left")
    # to cut a text at a place means to count up to it; for many places it is taken apart, once
    many = F.size("__kept") > FEW
    letters = F.when(many, F.split(text, "")).otherwise(F.array().cast("array<string>"))

    def cleaned(own):
        def piece(k):
            size = k["start"] - k["at"]
            whole = F.when(many, F.array_join(F.slice(own["letters"], k["at"] + 1, size), ""))
            return F.concat(whole.otherwise(F.substring(own["text"], k["at"] + 1, size)), F.lit(mark))

        tail = F.substring(own["text"], F.col("__tail") + 1, F.length(own["text"]))
        return F.concat(F.array_join(F.transform("__kept", piece), ""), tail)

    # the lambda's variable holds what would otherwise be computed again for each mark
    clean = F.transform(F.array(F.struct(letters.alias("letters"), text.alias("text"))), cleaned)[0]
    rows = rows.withColumn(text_col, F.when(F.col("__kept").isNull(), column(text_col)).otherwise(clean))
    return rows.select(*(column(c) for c in docs.columns))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its base spans, and with them the live strings that the owners' counts add."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(kind) for kind, *_ in BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def _op1_sql() -> str:
    """The same span by span: starts are sums of the lengths before them, owners are counted by value."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    # a run of 24 and more characters that none precedes is a whole run
    owned = (OWNED[0], "[A-Za-z0-9+/_-]+", *OWNED[2:])
    kinds = ", ".join(
        f"({quoted(kind)}, {k}, {quoted(pattern)}, {group}, {least})" for k, (kind, pattern, group, least) in enumerate((*BASE, owned))
    )
    return rf"""
WITH kinds(kind, rank, pattern, grp, least) AS (VALUES {kinds}
), parts AS (
  SELECT doc_id, source, md5(text) AS print, kind, rank, pattern, grp, least, regexp_extract_all(text, pattern) AS ms, string_split_regex(text, pattern) AS gaps
  FROM documents, kinds WHERE text IS NOT NULL AND regexp_matches(text, pattern)
), numbered AS (
  SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM parts
  WHERE rank < {len(BASE)} OR len(list_filter(ms, lambda m: length(m) >= least)) > 0
), placed AS (
  SELECT doc_id, source, print, kind, rank, least,
         list_sum(list_transform(gaps[1 : i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda m: length(m))), 0) AS begins,
         ms[i] AS m, CASE WHEN kind = 'assign' THEN regexp_extract(ms[i], pattern, 2) ELSE ms[i] END AS value
  FROM numbered
), spans AS (
  SELECT *, begins + length(m) AS ends FROM placed WHERE length(value) >= least
), texts AS (
  SELECT value, print, min(source) AS source, min(CAST(doc_id AS VARCHAR)) AS repo FROM spans GROUP BY value, print
), owners AS (
  SELECT value, count(DISTINCT source) AS n, count(DISTINCT repo) AS repos FROM texts GROUP BY value
), judged AS (
  SELECT s.*, n <= {MOST_OWNERS} AND (n = 1 OR repos <= {MOST_REPOS}) AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')
         AND len(list_distinct(string_split(value, ''))) >= {LEAST_VARIETY}
         AND NOT regexp_matches(value, {quoted(PLACEHOLDER)}) AS live
  FROM spans s JOIN owners USING (value)
), kept AS (
  SELECT doc_id, kind, rank, begins, ends, live, kind || ':' || begins::BIGINT || ':' || ends::BIGINT AS shown FROM judged j
  WHERE rank < {len(BASE)} OR live AND NOT EXISTS (
    FROM judged b WHERE b.doc_id = j.doc_id AND b.rank < {len(BASE)} AND b.begins < j.ends AND j.begins < b.ends)
), found AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live,
         string_agg(shown, ',' ORDER BY begins, rank, ends) FILTER (rank < {len(BASE)}) AS base,
         string_agg(shown, ',' ORDER BY begins, rank, ends) AS spans
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM documents d LEFT JOIN found USING (doc_id)
"""


OP1_SQL = _op1_sql()
