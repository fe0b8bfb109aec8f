"""Secret scans with corpus-wide ownership of each candidate, with DataFrame and SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, looked_up, materialise, quoted, text_or_empty, unboxed

#: A candidate counts as a widely copied example if this many owners hold it, or two owners in this many repositories.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
PLACEHOLDER = "<SECRET>"
#: Matches that are folded before their spans are put aside.
CHUNK = 256


@dataclass(frozen=True)
class Kind:
    """What to look for: ``gate`` is a cheap pattern that every match implies, ``least`` the length of ``group``.

    ``tail`` goes on after ``pattern``, for what SQL's engine can't match; ``core`` is what is taken out of a value before owners are
    counted, so that one secret in several layouts is one candidate.
    """

    name: str
    gate: str
    pattern: str
    group: int = 0
    least: int = 0
    tail: str = ""
    core: str = ""


_GAP = r"(?:[\s\x22\x27>,#*+/]|\\[nrt])*+"
#: After the first line of a key: all up to the last line, else (a key that is cut off) the headers and lines of base64 that follow. Possessive, so no
#: match needs a deep stack.
_PEM_TAIL = (
    r"(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}[A-Za-z][A-Za-z-]*+:\x20[^\r\n\\]*+)*+(?:{_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++(?:(?:[\x22\x27+,\s]|\\[nrt])++[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?=[\x22\x27\s\\]|$))?+)?+"
)
_PEM_CORE = r"-----(?:BEGIN|END) [A-Z ]*-----|\\[nrt]|[^A-Za-z0-9+/=]"

#: Fixed values. The first three are the base kinds.
BASE = (
    Kind(
        "assign", "(?i)password|passwd|secret|token|api_?key",
        """(?i:(password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12,
    ),
    Kind("access", "AKIA[A-Z0-9]{14}", "AKIA[A-Z0-9]+", 0, 18),
    Kind("hex", "[0-9a-f]{16}", "[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Kind("pem", "PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----", tail=_PEM_TAIL, core=_PEM_CORE),
    Kind("github", "gh[pousr]_", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Kind("jwt", "eyJ", "eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]+"),
    Kind("slack", "xox[abprs]-", "xox[abprs]-[A-Za-z0-9-]{10,}"),
)
KINDS = BASE + MORE

_SPAN = "struct<start: int, rank: int, kind: string, end: int, value: string>"


def _literal(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def _spans(kind: Kind, rank: int, text: str) -> str:
    """Leftmost matches that don't overlap. The text between matches (field 0) gives the places of matches (1) and values (2), in code points.

    Matches are folded in chunks, whose spans are put together once at the end, so the time grows with the text.
    """
    p = _literal(kind.pattern + kind.tail)
    inner = f"""
        aggregate(
            slice(z, c * {CHUNK} + 1, {CHUNK}),
            struct(s.at AS at, cast(array() AS array<{_SPAN}>) AS spans),
            (q, x) -> struct(
                q.at + length(x.`0`) + coalesce(length(x.`1`), 0) AS at,
                CASE WHEN length(x.`2`) >= {kind.least}
                     THEN concat(q.spans, array(struct(q.at + length(x.`0`) AS start, {rank} AS rank, '{kind.name}' AS kind,
                                                       q.at + length(x.`0`) + length(x.`1`) AS end, x.`2` AS value)))
                     ELSE q.spans END AS spans))
    """
    fold = f"""
        transform(
            array(arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {kind.group}))),
            z -> aggregate(
                sequence(0, (size(z) - 1) div {CHUNK}),
                struct(0 AS at, cast(array() AS array<array<{_SPAN}>>) AS parts),
                (s, c) -> transform(array({inner}), r -> struct(r.at AS at, concat(s.parts, array(r.spans)) AS parts))[0],
                s -> flatten(s.parts)))[0]
    """
    return f"CASE WHEN {text} RLIKE {_literal(kind.gate)} THEN {fold} ELSE cast(array() AS array<{_SPAN}>) END"


def secret_spans(text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> Column:
    """Array of the spans in a text column, by start and then by the order of ``kinds``; none in a null text."""
    return F.coalesce(F.array_sort(F.concat(*[F.expr(_spans(k, i, quoted(text))) for i, k in enumerate(kinds)])), F.expr(f"cast(array() AS array<{_SPAN}>)"))


def span_text(spans: str, most_rank: int = len(KINDS)) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.expr(f"array_join(transform(filter({spans}, s -> s.rank < {most_rank}), s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def _candidate(span: str) -> Column:
    """Hash by which the owners of a span's value are counted: of its core, or of the whole value where no core is left."""
    value = F.col(f"{span}.value")
    for k in KINDS:
        if k.core:
            core = F.regexp_replace(F.col(f"{span}.value"), k.core, "")
            value = F.when((F.col(f"{span}.kind") == k.name) & (core != ""), core).otherwise(value)
    return F.sha2(value, 256)


def _row_hash(key: str, owner: str, text: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")), F.coalesce(F.col(quoted(owner)).cast("string"), F.lit("")), text_or_empty(quoted(text))), 256)


def find_secrets(docs: DataFrame, key: str = "doc_id", owner: str = "source", text: str = "text", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(key, owner, row id, spans, live) of every row of ``docs``.

    ``spans`` are all candidates of the whole text; ``live`` are those among them that look like somebody's working
    credentials: in the whole corpus fewer than ``example_owners`` owners hold them, and if two do, fewer than
    EXAMPLE_REPOSITORIES repositories. Candidates are compared by the SHA-256 of their value (private keys: of their body); each distinct row is a
    repository (the table has no column for it) and null owners count as one owner. ``_row`` is the content hash that ties results to rows; repeated rows
    get equal results. Null and empty texts have no spans; an empty table gives an empty one. Other columns are left out.
    """
    found = docs.select(
        F.col(quoted(key)).alias("_key"), F.coalesce(F.col(quoted(owner)).cast("string"), F.lit("")).alias("_owner"), secret_spans(text).alias("spans"),
        _row_hash(key, owner, text).alias("_row"),
    )
    found = materialise(found, "secrets")
    one = found.where("size(spans) > 0").select("_row", "_owner", F.explode("spans").alias("span")).withColumn("_value", _candidate("span"))
    held = one.groupBy("_value").agg(F.count_distinct("_owner").alias("_owners"), F.count_distinct("_row").alias("_repositories"))
    copied = (F.col("_owners") >= example_owners) | ((F.col("_owners") > 1) & (F.col("_repositories") >= EXAMPLE_REPOSITORIES))
    live = looked_up(one, held.where(~copied).select("_value"), ["_value"], "_row", "inner")
    live = live.groupBy("_row").agg(F.array_sort(F.collect_set("span")).alias("_live"))
    none = F.expr(f"cast(array() AS array<{_SPAN}>)")
    out = found.join(live, "_row", "left").withColumn("live", F.coalesce("_live", none))
    return out.select("_row", F.col("_key").alias(key), "_owner", "spans", "live")


def _replaced(text: str, live: str) -> Column:
    """``text`` with the values of the spans ``live`` replaced; of spans that overlap the first counts.

    In chunks of spans: each takes its stretch of the text out once, so no span is looked for from the text's start.
    """
    inner = f"""
        aggregate(
            slice({live}, c * {CHUNK} + 1, {CHUNK}),
            struct(s.at AS at, cast(array() AS array<string>) AS parts),
            (q, x) -> CASE WHEN x.end <= q.at THEN q ELSE struct(
                x.end AS at,
                concat(q.parts, array(substring(w, q.at - s.at + 1, greatest(x.end - length(x.value) - q.at, 0)), '{PLACEHOLDER}')) AS parts) END)
    """
    return F.expr(f"""
        aggregate(
            sequence(0, (size({live}) - 1) div {CHUNK}),
            struct(0 AS at, cast(array() AS array<string>) AS parts),
            (s, c) -> transform(
                array(substring({text}, s.at + 1, greatest(array_max(transform(slice({live}, c * {CHUNK} + 1, {CHUNK}), x -> x.end)) - s.at, 0))),
                w -> transform(array({inner}), r -> struct(r.at AS at, concat(s.parts, array(array_join(r.parts, ''))) AS parts))[0])[0],
            s -> concat(array_join(s.parts, ''), substring({text}, s.at + 1)))
    """)


def redact(docs: DataFrame, key: str = "doc_id", owner: str = "source", text: str = "text", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``docs`` with the value of every live-looking credential replaced by a placeholder; other rows stay as they are.

    Only rows in which some kind's gate fires are joined with the verdicts. Null and empty texts, repeated rows and columns of any
    other names stay as they are; an empty table gives an empty one.
    """
    gate = F.coalesce(F.expr(" OR ".join(f"{quoted(text)} RLIKE {_literal(k.gate)}" for k in KINDS)), F.lit(False))
    live = find_secrets(docs, key, owner, text, example_owners).where("size(live) > 0").select("_row", "live").dropDuplicates(["_row"])
    hit = docs.where(gate).select(_row_hash(key, owner, text).alias("_row"), F.col(quoted(text)).alias("_text"), boxed(docs).alias("_doc")).join(live, "_row", "left")
    new = F.when(F.col("live").isNull(), F.col("_text")).otherwise(_replaced("_text", "live"))
    changed = hit.select(*[new.alias(c) if c == text else of for c, of in zip(docs.columns, unboxed("_doc", docs.columns), strict=True)])
    return docs.where(~gate).unionByName(changed)
