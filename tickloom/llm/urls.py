"""URL filters: site rules and URL patterns, fetched by their rarest literal token.

Every rule is a regular expression with some literal tokens (runs of letters and
digits) that a fitting URL must hold whole.  The corpus tells how many URLs hold
each of these tokens; a rule is filed under its rarest one.  A URL's own tokens
fetch the rules filed under them, and only those expressions are run.  A rule
without such a token is filed under the empty token, which every URL holds.

Rules are a table, as large as it may be.  Within a bound of bytes it is sent to
all tasks; beyond it URLs' tokens and rules meet by a shuffle, in which the empty
token, and whoever is filed under it, is spread over SALTS keys.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from ..sources import folders
from .common import ascii_lower, column, saved, table

#: Runs of anything but ASCII letters and digits and characters beyond ASCII, in lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Rules of so many bytes are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
SALTS = 64

RULES = "name string, verdict string, site boolean, pattern string, tokens array<string>"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str  # allow or block
    site: bool  # a site rule sees host and path, a pattern the lower-cased URL
    pattern: str  # regular expression
    tokens: tuple[str, ...]  # literal tokens that a fitting URL holds whole


def _quoted(text: str) -> str:
    return "".join(c if TOKEN.fullmatch(c) or c.isupper() else "\\" + c if c.isascii() else c for c in text)


def site_rule(name: str, verdict: str) -> Rule:
    """host/path: fits the host and its subdomains where the path starts with the rule's."""
    host, slash, path = name.partition("/")
    whole = TOKEN.findall(name.lower())
    if name and TOKEN.fullmatch(name[-1].lower()):
        whole = whole[:-1]  # the last token may go on in the URL
    return Rule(name, verdict, True, rf"^(?:[^/]*\.)?{_quoted(host)}{_quoted(slash + path)}", tuple(whole))


def url_pattern(name: str, verdict: str) -> Rule:
    """A pattern of lower-case text, * for any run of characters, ^ for one separator or an end of the URL."""
    pieces, tokens = [], []
    for piece in re.split(r"([*^])", name):
        pieces.append({"*": ".*", "^": r"(?:[\x00-\x2F\x3A-\x60\x7B-\x7F]|^|$)"}.get(piece, _quoted(piece)))
    for m in TOKEN.finditer(name):
        before, after = name[: m.start()][-1:], name[m.end() :][:1]
        if before not in ("", "*") and after not in ("", "*"):
            tokens.append(m.group())
    return Rule(name, verdict, False, "(?s)" + "".join(pieces), tuple(tokens))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL, the empty one among them."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(ascii_lower(url), GAP)))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as a table, written as text by the driver and read by Spark; a large list is better kept as one."""
    path = f"{work_dir(spark, 'url-rule-list')}/rules.json"
    folders.put_if_absent(spark, path, "\n".join(json.dumps(asdict(rule)) for rule in rules))
    return spark.read.schema(RULES).json(path)


def checked(rules: DataFrame) -> bool:
    """Whether the rules are few enough to be broadcast; an error if two have one name, or one has none."""
    texts = sum((F.coalesce(F.octet_length(name), F.lit(0)) for name in ("name", "verdict", "pattern")), F.lit(64))
    whole = F.aggregate("tokens", F.lit(0), lambda n, t: n + F.octet_length(t) + 16)
    found = rules.agg(
        F.count("*").alias("n"),
        F.countDistinct("name").alias("names"),
        F.coalesce(F.sum(texts + F.coalesce(whole, F.lit(0))), F.lit(0)).alias("bytes"),
    ).first()
    if found.names < found.n:
        raise ValueError("rules need different names")
    return found.bytes <= BROADCAST_BYTES


def rule_index(pages: DataFrame, rules: DataFrame, small: bool) -> DataFrame:
    """(token, salt, rule): each rule under the token, of those it must hold, that the fewest of all URLs of pages hold.

    Of equally rare tokens the first counts.  Rules without tokens come once for every salt.
    """
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    held = pages.select(F.explode(tokens_of(F.col("url"))).alias("token"))
    # a few tokens are in most URLs: counted before anything is shuffled
    counts = held.join(F.broadcast(wanted), "token", "left_semi") if small else held
    counts = counts.groupBy("token").agg(F.count("*").alias("n"))
    each = rules.select("name", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"]
    filed = each.groupBy("name").agg(rarest.alias("token"))
    index = rules.join(filed, "name", "left").select(
        F.coalesce("token", F.lit("")).alias("token"), F.struct("name", "verdict", "site", "pattern").alias("rule")
    )
    salts = F.when(F.col("token") == "", F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return saved(index.select("token", F.explode(salts).alias("salt"), "rule"), "url-rules")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, patterns) of every row.

    rules: a list, or a table with the columns of RULES; names are unique.
    The longest fitting site rule decides (of equally long ones the last in
    order); where none fits, a URL is blocked if a blocking pattern fits and no
    allowing one does.  ``patterns`` lists the patterns that fit.  A NULL url
    counts as empty; without "://" host and path are empty.  Repeated rows and
    rows without an id each keep their row; without rules all are allowed.
    Other columns are ignored.
    """
    if isinstance(rules, list):
        rules = rule_table(pages.sparkSession, rules)
    small = checked(rules)
    rows = pages.select(column(id_col).alias("id"), F.coalesce(column(url_col).cast("string"), F.lit("")).alias("url"))
    index = rule_index(rows, rules, small)
    host, path = host_and_path(F.col("url"))
    # equal rows become one with a count; where rules are broadcast, all that follows stays in its partition
    rows = rows.groupBy("id", "url").agg(F.count("*").alias("copies"))
    rows = rows.select("*", host.alias("host"), path.alias("path"), F.explode(tokens_of(F.col("url"))).alias("token"))
    salt = F.when(F.col("token") == "", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).otherwise(0)
    fetched = rows.withColumn("salt", salt).join(F.broadcast(index) if small else index, ["token", "salt"], "left")
    # a URL's empty token stays in any case, and with it the URL
    fetched = fetched.filter((F.col("token") == "") | F.col("rule").isNotNull())
    place, url = F.concat("host", "path"), ascii_lower(F.col("url"))
    pattern = F.col("rule.pattern")
    fit = F.when(F.col("rule.site"), F.rlike(place, pattern)).otherwise(F.rlike(url, pattern))
    fetched = fetched.withColumn("fit", fit)
    site, own = F.col("fit") & F.col("rule.site"), F.col("fit") & ~F.col("rule.site")
    longest = F.struct(F.length("rule.name").alias("n"), F.col("rule.name").alias("name"), F.col("rule.verdict").alias("verdict"))
    says = lambda verdict: F.coalesce(F.bool_or(own & (F.col("rule.verdict") == verdict)), F.lit(False))
    judged = fetched.groupBy("id", "url", "copies", "host", "path").agg(
        F.max(F.when(site, longest)).alias("best"),
        F.sort_array(F.collect_list(F.when(own, F.col("rule.name")))).alias("patterns"),
        F.when(says("block") & ~says("allow"), "block").otherwise("allow").alias("own"),
    )
    return judged.select(
        "id",
        "host",
        "path",
        F.col("best.name").alias("rule"),
        F.coalesce("best.verdict", "own").alias("verdict"),
        "patterns",
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


#: Site rules of the query, and its URL patterns.
SITES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PATTERNS = (
    ("^spam-farm^", "block"),
    ("^cheap-pills^", "block"),
    ("^casino^", "block"),
    ("^adserver^", "block"),
    ("^tracker^*^pixel^", "block"),
    ("^utm_source=spam^", "block"),
    ("^spam-farm^*^about^", "allow"),
)


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [site_rule(*r) for r in SITES] + [url_pattern(*r) for r in PATTERNS]
    found = judge_urls(table(spark, sf_dir, "pages"), rules)
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


#: The same by trying every rule on every URL.
OP2_SQL = r"""
WITH lower_ascii AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM pages
), parts AS (
  SELECT page_id, low, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM lower_ascii
), places AS (
  SELECT page_id, low,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM places
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(low, '(^|[^a-z0-9\x{80}-\x{10FFFF}])(spam-farm|cheap-pills|casino|adserver|utm_source=spam)([^a-z0-9\x{80}-\x{10FFFF}]|$)')
       AND NOT regexp_matches(low, '(^|[^a-z0-9\x{80}-\x{10FFFF}])spam-farm[^a-z0-9\x{80}-\x{10FFFF}].*[^a-z0-9\x{80}-\x{10FFFF}]about([^a-z0-9\x{80}-\x{10FFFF}]|$)')
    OR regexp_matches(low, '(^|[^a-z0-9\x{80}-\x{10FFFF}])tracker[^a-z0-9\x{80}-\x{10FFFF}].*[^a-z0-9\x{80}-\x{10FFFF}]pixel([^a-z0-9\x{80}-\x{10FFFF}]|$)')
  THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
