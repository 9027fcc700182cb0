"""Secret scans with corpus-wide ownership: who holds a candidate value, and how many others.

Spans come from patterns; the position of each match is the length of what lies before it, a
running sum over the matches of a text.
A candidate's hash is counted over distinct owners and repositories of the whole corpus: a
value that many owners hold, or a few in many repositories, is a widely copied example; one
that stays with its owner is live if it is named as a secret (an assignment, an access key, a vendor's prefix) or looks random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quincunx.llm.common import written

# The patterns of the three base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# A run of hexadecimal digits is matched whole, so asking for 16 drops the same runs as a later test.
HEX = r"[0-9a-f]{16,}"
# A wider candidate, of which only live ones count: a long unbroken run, vendor prefix or not.
VENDOR = r"(?:gh[pousr]_|sk_live_|xox[abp]-)"
WIDE = VENDOR + r"?[A-Za-z0-9]{24,}"
EXAMPLE = r"(?i)example|placeholder|changeme|xxxxxx"
EVENNESS = 0.65  # of the largest entropy that a run's length and alphabet allow

KINDS = ("assign", "access", "hex", "live")
COPIED_OWNERS = 3  # a value with so many owners is an example
COPIED_REPOSITORIES = 8  # so is one in so many repositories of two owners and more
MATCH = "struct<kind:int,place:int,gap:int,length:int,usable:boolean,looks:boolean,hash:string>"
SEGMENT = 1_000  # characters of a text that are cut up together


def matches_of(text: Column, pattern: str, kind: int, group: int, accept) -> Column:
    """Array of the pattern's matches in order: their place, the gap before each, their length,
    whether ``accept(value)`` holds, whether the value looks live, and its hash.

    Between two matches lies one piece of the split text, so a match ends where all gaps and
    lengths up to it do.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    wholes = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else wholes
    found = F.arrays_zip(F.slice(gaps, 1, F.size(wholes)).alias("gap"), wholes.alias("whole"), values.alias("value"))

    def match(m: Column, place: Column) -> Column:
        usable = accept(m["value"])
        return F.struct(
            F.lit(kind).alias("kind"), place.alias("place"), m["gap"].alias("gap"), F.length(m["whole"]).alias("length"),
            usable.alias("usable"), (usable & live_looking(m["value"], F.lit(kind))).alias("looks"),
            F.when(usable, F.sha2(m["value"], 256)).alias("hash"),
        )

    none = F.array().cast(f"array<{MATCH}>")
    return F.when(text.rlike(pattern), F.transform(found, match).cast(f"array<{MATCH}>")).otherwise(none)


def random_run(value: Column) -> Column:
    """Letters and digits, with characters as evenly spread as in a random text of that length
    and alphabet; other runs than hexadecimal ones also change kind of character three times."""
    chars = F.filter(F.array_distinct(F.split(value, "")), lambda c: c != "")
    n = F.length(value)

    def term(total: Column, c: Column) -> Column:
        k = (n - F.length(F.replace(value, c, F.lit("")))).cast("double")
        return total + k * F.log2(k)

    entropy = F.log2(n) - F.aggregate(chars, F.lit(0.0), term) / n
    hexadecimal = value.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    size = lambda pattern, many: F.when(value.rlike(pattern), many).otherwise(0)
    alphabet = F.when(hexadecimal, 16).otherwise(size("[0-9]", 10) + size("[a-z]", 26) + size("[A-Z]", 26))
    changes = F.regexp_count(value, F.lit("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"))
    return (
        value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (hexadecimal | (changes >= 3))
        & (entropy >= EVENNESS * F.log2(F.least(n, alphabet)))
    )


def live_looking(value: Column, kind: Column) -> Column:
    """Not marked as an example and, where only its shape speaks for a bare run, random.

    What an assignment, an access key's or a vendor's prefix names as a secret needs no test.
    """
    named = kind.isin(0, 1) | value.rlike(f"^{VENDOR}")
    return ~value.rlike(EXAMPLE) & (named | random_run(value))


def matches(text: Column) -> Column:
    """All matches of the four kinds; null texts have none."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(
        matches_of(text, ASSIGN, 0, 2, lambda v: F.length(v) >= 12),
        matches_of(text, ACCESS, 1, 0, lambda v: F.length(v) >= 18),
        matches_of(text, HEX, 2, 0, lambda v: F.lit(True)),
        matches_of(text, WIDE, 3, 0, lambda v: F.lit(True)),
    )


def spans_of(found: DataFrame) -> DataFrame:
    """(_row, _owner, _repository, kind, start, end, looks, hash) of (_row, _owner, _repository, _matches).

    Base spans are those with a usable value; a wide candidate must look live and touch no base
    span.  Matches become rows, so their positions are running sums and a row may have any
    number of them; no text and no value travels.
    """
    rows = found.select("_row", "_owner", "_repository", F.explode("_matches").alias("m"))
    rows = rows.select("_row", "_owner", "_repository", "m.*").repartition("_row")
    upto = Window.partitionBy("_row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto).cast("int"))
    rows = rows.withColumn("start", F.col("end") - F.col("length")).where((F.col("kind") < 3) & F.col("usable") | F.col("looks"))
    # The farthest end of the base spans that start no later, the nearest start of those that start no earlier.
    base = F.col("kind") < 3
    reach = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("_row").orderBy("start"))
    onward = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("_row").orderBy(F.desc("start")))
    rows = rows.withColumns({"_reach": reach, "_onward": onward})
    touched = F.coalesce(F.col("_reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_onward") < F.col("end"), F.lit(False))
    return rows.where(base | ~touched).select("_row", "_owner", "_repository", "kind", "start", "end", "looks", "hash")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of every candidate value of (hash, _owner, _repository).

    Rows are first reduced to distinct (hash, owner, repository), on the map side, so a value
    copied into a third of the corpus is a few rows per task.
    """
    holders = spans.select("hash", "_owner", "_repository").distinct()
    return holders.groupBy("hash").agg(
        F.countDistinct("_owner").alias("owners"), F.countDistinct("_repository").alias("repositories")
    )


def widely_held(
    owners: Column, repositories: Column, copied: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES
) -> Column:
    return (owners >= copied) | (owners >= 2) & (repositories >= copied_repositories)


def classified(found: DataFrame, copied: int, repositories: int) -> DataFrame:
    """(_row, start, kind, end, owners, repositories, live) of all spans of the stored table ``found``."""
    spans = written(spans_of(found.where("size(_matches) > 0")), "spans")
    held = widely_held(F.col("owners"), F.col("repositories"), copied, repositories)
    judged = spans.join(ownership(spans), "hash").withColumn("live", ~held & F.col("looks"))
    return judged.where("kind < 3 OR live").select("_row", "start", "kind", "end", "owners", "repositories", "live")


def scanned(
    docs: DataFrame, *, owner: str = "source", repository: str = "concat_ws('/', source, lang)", copied: int = COPIED_OWNERS,
    copied_repositories: int = COPIED_REPOSITORIES, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, spans) of every row: spans {start, kind, end, owners, repositories, live}.

    ``owner`` and ``repository`` are SQL over ``docs``; null ones count as no owner, so such a
    value is not widely copied.  A value is widely copied if ``copied`` owners hold it, or two
    owners in ``copied_repositories`` repositories; over repositories of one owner it stays
    its owner's.  Base spans always stay; wide candidates only if live.  Positions are code
    points, the end exclusive.  Null texts are empty; repeated rows and null keys are scanned
    like any others.
    """
    found = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.expr(owner).alias("_owner"), F.expr(repository).alias("_repository"),
        matches(F.col(text)).alias("_matches"),
    )
    found = written(found.withColumn("_row", F.monotonically_increasing_id()), "matches")
    judged = classified(found, copied, copied_repositories).select("_row", F.struct("start", "kind", "end", "owners", "repositories", "live").alias("j"))
    judged = judged.groupBy("_row").agg(F.sort_array(F.collect_list("j")).alias("_judged"))
    empty = F.expr("cast(array() AS array<struct<start:int,kind:int,end:int,owners:bigint,repositories:bigint,live:boolean>>)")
    return found.select("doc_id", "_row").join(judged, "_row", "left").select(
        "doc_id", F.coalesce("_judged", empty).alias("spans")
    )


def labelled(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def regions(live: DataFrame) -> DataFrame:
    """(_row, _regions): what the spans of a row cover, as a sorted array of {start, end}."""
    order = Window.partitionBy("_row").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    live = live.withColumn("_fresh", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    live = live.withColumn("_number", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    live = live.groupBy("_row", "_number").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return live.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_regions"))


def masked(text: Column, places: Column, mask: str) -> Column:
    """The text with ``mask`` for each of the sorted ``places``.

    Finding a character means walking there from the start, so the text is cut into segments
    once, and what lies between two places is taken from the segments it touches.
    """
    segments = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))

    def part(held: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / SEGMENT).cast("int")
        joined = F.array_join(F.slice(held, first + 1, F.floor(end / SEGMENT).cast("int") - first + 1), "")
        return F.substring(joined, start - first * SEGMENT + 1, end - start)

    def mended(held: Column) -> Column:
        before = lambda k: F.coalesce(F.get(places, k - 1)["end"], F.lit(0))
        pieces = F.transform(places, lambda p, k: F.concat(part(held, before(k), p["start"]), F.lit(mask)))
        return F.concat(F.array_join(pieces, ""), part(held, F.element_at(places, -1)["end"], F.length(text)))

    return F.when(places.isNotNull(), F.transform(F.array(segments), mended)[0]).otherwise(text)


def redacted(
    docs: DataFrame, *, owner: str = "source", repository: str = "concat_ws('/', source, lang)", copied: int = COPIED_OWNERS,
    copied_repositories: int = COPIED_REPOSITORIES, text: str = "text", mask: str = "[secret]",
) -> DataFrame:
    """``docs`` with all live secrets masked, touching ones by one mask each and overlapping ones
    by one together; widely copied examples and other texts stay.

    All rows and columns stay.  Only rows with a candidate are stored and joined.
    """
    any_kind = F.coalesce(F.col(text).rlike("|".join([ASSIGN, ACCESS, HEX, WIDE])), F.lit(False))
    found = docs.where(any_kind).select(
        F.struct("*").alias("_doc"), F.expr(owner).alias("_owner"), F.expr(repository).alias("_repository"),
        matches(F.col(text)).alias("_matches"),
    )
    found = written(found.withColumn("_row", F.monotonically_increasing_id()), "candidates")
    places = regions(classified(found, copied, copied_repositories).where("live"))
    mended = found.select("_doc", "_row").join(places, "_row", "left")
    own = F.col("_doc")[text]
    columns = [masked(own, F.col("_regions"), mask).alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns]
    return docs.where(~any_kind).unionByName(mended.select(*columns))
