"""Secret scan with corpus-wide ownership frequency, DataFrame functions only.

Candidates are found by pattern. Places come without a Python pass: the pieces between matches
(split) and the matches (extract all) alternate, so a running sum of their lengths over a text's
exploded matches gives code-point offsets, in time linear in their number. Each candidate's value
is hashed, and the distinct repositories and owners that hold the hash are counted over the corpus.
A value in many owners' or repositories' texts is a copied example; a value of a single, known owner
that looks random is taken for a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pin


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The base kinds in order, their patterns and least lengths.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(map(_either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: Kinds in output order at one start; the last two are the verdicts on a candidate's value.
KINDS = ("assign", "access", "hex", "copied", "live")
#: A value is copied from so many owners, or repositories, on.
COPIED_OWNERS = 3
COPIED_REPOS = 8
#: A live-looking value has so many different characters, digits and letters among them.
LIVE_CHARACTERS = 8

# Shorter runs need not be listed to be dropped where a match is a maximal run anyway.
_PATTERNS = {"assign": (ASSIGN, 2, ASSIGN_LEAST), "access": (ACCESS.replace("+", f"{{{ACCESS_LEAST - 4},}}+"), 0, ACCESS_LEAST), "hex": (HEX.replace("+", f"{{{HEX_LEAST},}}+"), 0, HEX_LEAST)}


def _matches(text: str, kind: str, rank: int) -> Column:
    """Array of (rank, gap, chars, value) of one kind in the column ``text``: all matches in order.

    gap is the number of code points between the last match of the kind and this one.
    """
    pattern, group, _ = _PATTERNS[kind]
    literal = "r'" + pattern.replace("'", "\\x27") + "'"
    value = f"regexp_extract(m, {literal}, {group})" if group else "m"
    none = "cast(array() as array<struct<rank: int, gap: int, chars: int, value: string>>)"
    zipped = f"zip_with(slice(split({text}, {literal}, -1), 1, size(w)), w, (p, m) -> named_struct('rank', {rank}, 'gap', length(p), 'chars', length(m), 'value', {value}))"
    return F.expr(f"transform(array(regexp_extract_all({text}, {literal}, 0)), w -> if(size(w) = 0, {none}, {zipped}))[0]")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(id, owner, repo, found): one row per row of ``docs``, found is (rank, gap, chars, value)s.

    A null owner stays null; null parts of a repository count as empty.
    """
    repo = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols))
    texts = docs.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), repo.alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = [_matches("text", kind, rank) for rank, kind in enumerate(_PATTERNS)]
    return texts.select("id", "owner", "repo", F.concat(*kinds).alias("found"))


def placed(scanned: DataFrame) -> DataFrame:
    """(row, id, owner, repo, c, hash) of ``scanned`` (row, id, owner, repo, found): candidates with start and end.

    c is (start, rank, end, value). Matches that are too short shift the later ones and then leave.
    """
    each = scanned.select("row", "id", "owner", "repo", F.posexplode("found").alias("pos", "m"))
    so_far = Window.partitionBy("row", "m.rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.chars")).over(so_far)
    least = F.element_at(F.array(*(F.lit(n) for *_, n in _PATTERNS.values())), F.col("m.rank") + 1)
    ended = each.withColumn("end", end).filter(F.length("m.value") >= least)
    c = F.struct((F.col("end") - F.col("m.chars")).alias("start"), F.col("m.rank").alias("rank"), F.col("end").alias("end"), F.col("m.value").alias("value"))
    return ended.select("row", "id", "owner", "repo", c.alias("c"), F.sha2("m.value", 256).alias("hash"))


def looks_live(value: Column) -> Column:
    varied = F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS
    return varied & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def ownership(held: DataFrame) -> DataFrame:
    """(hash, repos, owners, unknown): distinct repositories and owners of each value of ``held`` (hash, owner, repo).

    Duplicates go before the shuffle: a hash is first brought down to its distinct repositories.
    unknown says that a text without an owner holds it, so that one owner may not be the only one.
    """
    by_repo = held.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("owner").alias("owners"), F.bool_or(F.col("owner").isNull()).alias("unknown"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(id, spans): one row per row of ``docs``; spans is a sorted array of (start, rank, end, hash, repos, owners).

    rank indexes KINDS. Base spans always stay; each candidate may add a span over its value:
    "copied" from COPIED_OWNERS owners or COPIED_REPOS repositories on, "live" with one owner, and
    none unknown, if it looks random. Starts and ends are code points. Null texts count as empty,
    null owners as unknown ones, null parts of a repository as empty. Repeated rows are scanned each
    for itself and count once as owners. Rows with the same id stay apart. An empty table gives an
    empty result; other columns are not read.
    """
    scanned = pin(candidates(docs, id_col, text_col, owner_col, repo_cols).withColumn("row", F.monotonically_increasing_id()))
    each = placed(scanned)
    judged = each.join(ownership(each), "hash")
    copied = (F.col("owners") >= COPIED_OWNERS) | (F.col("repos") >= COPIED_REPOS)
    own = (F.col("owners") == 1) & ~F.col("unknown")
    verdict = F.when(copied, KINDS.index("copied")).when(own & looks_live(F.col("c.value")), KINDS.index("live"))
    span = lambda start, rank: F.struct(start.alias("start"), rank.cast("int").alias("rank"), F.col("c.end").alias("end"), "hash", "repos", "owners")
    both = F.filter(F.array(span(F.col("c.start"), F.col("c.rank")), span(F.col("c.end") - F.length("c.value"), verdict)), lambda x: x.rank.isNotNull())
    spans = judged.select("row", F.explode(both).alias("s")).groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return scanned.select("row", "id").join(spans, "row", "left").select("id", F.coalesce("spans", none).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x.rank + 1), x.start.cast("string"), x.end.cast("string"))), ",")
