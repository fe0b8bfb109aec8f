"""Text jobs over ideas: concept tags, parameters, gates, look-alikes, neighbours."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stage
from .joins import fuzzy_duplicates

#: Concept, role ('' for none) and keywords, in the order in which concepts are reported.
CONCEPTS = (
    ("BOS", "entry", ("bos",)), ("CHOCH", "entry", ("choch",)), ("DISPLACEMENT", "entry", ("displacement",)), ("FVG", "zone", ("fvg",)), ("OB", "zone", ("order block", "ob")),
    ("OTE", "zone", ("ote",)), ("SWEEP", "entry", ("sweep",)), ("JUDAS", "entry", ("judas swing", "judas")), ("SILVER_BULLET", "entry", ("silver bullet",)),
    ("BREAKER", "zone", ("breaker block", "breaker")), ("RB", "zone", ("rejection block", "rb")), ("VB", "zone", ("vacuum block", "vb")), ("MMXM", "entry", ("mmxm",)),
    ("MB", "zone", ("mitigation block", "mb")), ("NDOG", "entry", ("ndog",)), ("NWOG", "entry", ("nwog",)), ("EHPDA_BOUNCE", "entry", ("ehpda bounce", "ehpda_bounce")),
    ("NARRATIVE", "context", ("narrative",)), ("KILLZONE", "timing", ("killzone",)), ("MACRO_TIMING", "timing", ("macro timing",)),
    ("MAKRO_ZEITFENSTER", "timing", ("makro zeitfenster", "makro-zeitfenster")), ("PREMIUM", "context", ("premium",)), ("DISCOUNT", "context", ("discount",)), ("CBDR", "context", ("cbdr",)),
    ("DEALING_RANGE", "context", ("dealing range",)), ("CISD", "entry", ("cisd",)), ("OPENING_RANGE", "zone", ("opening range",)), ("MIDNIGHT_OPEN", "context", ("midnight open",)),
    ("HRL_LRL", "context", ("hrl lrl", "hrl/lrl")), ("PDA_REGIME", "context", ("pd array regime", "pda regime", "roentgenblick")),
    ("STAT_REGIME", "context", ("stat regime", "statistisches regime", "oberflaeche")), ("QUARTERLY_THEORY", "context", ("quarterly theory",)),
    ("SESSION_TIMING", "timing", ("session timing",)), ("SPECIAL_TIMING", "timing", ("special timing",)), ("WEEK_LEVELS", "zone", ("week levels",)),
    ("RTH_FILTER", "timing", ("rth filter",)), ("SMC_FVG", "zone", ("smc fvg",)), ("SMC_SESSIONS", "timing", ("smc sessions",)), ("SHANNON_CAPACITY", "context", ("shannon capacity",)),
    ("PRIGOGINE", "context", ("prigogine",)), ("CUSUM", "context", ("cusum",)), ("FVG_STANDARD", "entry", ("fvg standard", "fvg std", "3. fvg", "3 fvg")),
    ("IFVG_1WOCHE", "entry", ("ifvg 1woche", "ifvg woche", "4a", "ifvg 1w")), ("IFVG_SAMEDAY", "entry", ("ifvg sameday", "ifvg same", "4b")),
    ("FVG_2TAGE", "entry", ("fvg 2tage", "fvg 2t", "5a")), ("FVG_1_2WOCHEN", "entry", ("fvg 1-2wochen", "fvg wochen", "5b")),
    ("OB_CHAOS", "entry", ("ob chaos", "chaos ob", "chaos orderblock", "chaos order block", "7a")), ("OB_TAGESHOCH", "entry", ("ob tageshoch", "tageshoch ob", "tageshoch orderblock", "7b")),
    ("OB_SESSION", "entry", ("ob session", "session ob", "session orderblock", "7c")), ("OB_SESSION_HTIEF", "entry", ("ob session hoch-tief", "session hoch-tief", "7d", "s_ob htief")),
    ("MACRO_SHORT", "timing", ("macro short", "macro time short", "6a")), ("MACRO_LONG", "timing", ("macro long", "macro time long", "6b")),
    ("FVG_STD_FT", "entry", ("fvg standard first touch", "fvg std ft", "3 ft")), ("IFVG_1W_FT", "entry", ("ifvg 1woche first touch", "ifvg 1w ft", "4a ft")),
    ("IFVG_SD_FT", "entry", ("ifvg sameday first touch", "ifvg sd ft", "4b ft")), ("FVG_2T_FT", "entry", ("fvg 2tage first touch", "fvg 2t ft", "5a ft")),
    ("FVG_12W_FT", "entry", ("fvg 1-2wochen first touch", "fvg 12w ft", "5b ft")), ("OB_CHAOS_FT", "entry", ("ob chaos first touch", "chaos ob ft", "7a ft")),
    ("OB_TAGH_FT", "entry", ("ob tageshoch first touch", "tageshoch ob ft", "7b ft")), ("OB_SESS_FT", "entry", ("ob session first touch", "session ob ft", "7c ft")),
    ("S_OB_SESS_FT", "entry", ("s ob sess ft", "session ob ft small")), ("FVG_STD_ST50", "entry", ("fvg standard second touch", "fvg std st50", "3 st50")),
    ("IFVG_1W_ST50", "entry", ("ifvg 1woche second touch", "ifvg 1w st50", "4a st50")), ("IFVG_SD_ST50", "entry", ("ifvg sameday second touch", "ifvg sd st50", "4b st50")),
    ("FVG_2T_ST50", "entry", ("fvg 2tage second touch", "fvg 2t st50", "5a st50")), ("FVG_12W_ST50", "entry", ("fvg 1-2wochen second touch", "fvg 12w st50", "5b st50")),
    ("OB_CHAOS_ST50", "entry", ("ob chaos second touch", "chaos ob st50", "7a st50")), ("OB_TAGH_ST50", "entry", ("ob tageshoch second touch", "tageshoch ob st50", "7b st50")),
    ("OB_SESS_ST50", "entry", ("ob session second touch", "session ob st50", "7c st50")), ("S_OB_SESS_ST50", "entry", ("s ob sess st50", "session ob st50 small")),
    ("MANIP", "entry", ("manip", "manipulation", "liquidity sweep", "liquidity grab")), ("MANIP_BEAR", "entry", ("manip bear", "manip short", "bear manip", "liquidity sweep short")),
    ("TURTLE_SOUP", "context", ("turtle soup", "turtle_soup", "ts filter")), ("EXIT_ATR_TRAIL", "exit", ("exit atr trail", "atr trail")),
    ("EXIT_BREAKEVEN", "exit", ("exit breakeven", "breakeven")), ("EXIT_NEXT_ZONE", "exit", ("exit next zone", "next zone")),
    ("EXIT_SESSION_LEVEL", "exit", ("exit session level", "session level")), ("HURST", "context", ("hurst", "hurst exp", "mean reversion filter")),
    ("FVG_STD_DP", "entry", ("fvg standard displacement", "fvg std dp", "3 dp")), ("IFVG_1W_DP", "entry", ("ifvg 1woche displacement", "ifvg 1w dp", "4a dp")),
    ("IFVG_SD_DP", "entry", ("ifvg sameday displacement", "ifvg sd dp", "4b dp")), ("FVG_2T_DP", "entry", ("fvg 2tage displacement", "fvg 2t dp", "5a dp")),
    ("FVG_12W_DP", "entry", ("fvg 1-2wochen displacement", "fvg 12w dp", "5b dp")), ("OB_CHAOS_DP", "entry", ("ob chaos displacement", "chaos ob dp", "7a dp")),
    ("OB_TAGH_DP", "entry", ("ob tageshoch displacement", "tageshoch ob dp", "7b dp")), ("OB_SESS_DP", "entry", ("ob session displacement", "session ob dp", "7c dp")),
    ("S_OB_SESS_DP", "entry", ("s ob sess dp", "session ob dp small")),
)
#: Prefix of the entries by kind of touch, and the zone that they belong to.
ENTRY_ZONES = {
    "FVG_STD": "FVG_STANDARD", "IFVG_1W": "IFVG_1WOCHE", "IFVG_SD": "IFVG_SAMEDAY", "FVG_2T": "FVG_2TAGE", "FVG_12W": "FVG_1_2WOCHEN",
    "OB_CHAOS": "OB_CHAOS", "OB_TAGH": "OB_TAGESHOCH", "OB_SESS": "OB_SESSION", "S_OB_SESS": "OB_SESSION",
}
#: Stop in points where an idea names none; twice as much for long ideas on the second group.
GAP_STOP, GAP_ZONES = 5.0, ("FVG_STANDARD", "IFVG_1WOCHE", "IFVG_SAMEDAY", "FVG_2TAGE", "FVG_1_2WOCHEN")
BLOCK_STOP, BLOCK_ZONES = 10.0, ("OB_CHAOS", "OB_TAGESHOCH", "OB_SESSION", "OB_SESSION_HTIEF")
#: Sessions in the order in which they are looked for, stops, ways out.
SESSION_WORDS = (("london", ("london", "european")), ("ny", ("new york", "ny", "nyo", "american")), ("asia", ("asia", "asian", "tokyo")))
STOP = r"(?i)(?:sl|stop|stoploss|stop.loss)\s*[:\s]?\s*(\d+(?:\.\d+)?)\s*(?:punkte|pts|points|p\b)"
EXITS = (
    ("breakeven_trail", r"(?i)\bbreakeven\s+trail\b"), ("breakeven", r"(?i)\bbreakeven\b"), ("next_zone", r"(?i)\b(next|nächste)\s+zone\b"),
    ("session_level", r"(?i)\bsession\s+level\b"), ("atr_trail", r"(?i)\batr\s+trail\b"),
)
SESSIONS = ("LONDON", "NY", "ASIA")


def entries_of_zones() -> dict[str, list[str]]:
    """The entries by kind of touch of each zone that has such."""
    of_zone: dict[str, list[str]] = {}
    for prefix, zone in ENTRY_ZONES.items():
        of_zone.setdefault(zone, []).extend(c for c, _, _ in CONCEPTS if c.rpartition("_")[0] == prefix)
    return of_zone


def whole_words(keywords: Sequence[str]) -> str:
    """Pattern of any of the keywords with no letter, digit or underscore next to it, in any case."""
    return r"(?iU)(?<!\w)(?:" + "|".join(map(re.escape, keywords)) + r")(?!\w)"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda w: w != "")


def tag(ideas: DataFrame, text: str = "idea", keywords: Sequence[tuple[str, str, Sequence[str]]] | None = None) -> DataFrame:
    """``concepts``: those of which the text holds a keyword as whole words, in table order; ``roles``: theirs, each once."""
    table = CONCEPTS if keywords is None else keywords
    found = F.array_compact(F.array(*[F.when(F.col(text).rlike(whole_words(k)), F.struct(F.lit(c).alias("concept"), F.lit(r).alias("role"))) for c, r, k in table]))
    return ideas.withColumn("concepts", F.transform(found, lambda x: x["concept"])).withColumn("roles", F.array_distinct(F.transform(found, lambda x: x["role"])))


def parse(ideas: DataFrame, text: str = "idea") -> DataFrame:
    """What a text asks for: concepts, those of them that are entry, zone, context and timing, session, stop, direction, trail and exit_mode.

    A zone's entry by kind of touch replaces the zone itself; a zone that stays brings all its entries along, at the end of ``concepts``.
    'short' and 'long' in the name of a concept are no direction. Without a stop in points the first concept that has a usual one gives it.
    Each distinct text is looked at once, however many ideas have it.
    """
    found = _parsed(ideas.select(F.col(text).alias("_text")).distinct(), "_text")
    kinds = stage(found, "parsed")
    return ideas.drop(*[c for c in found.columns if c != "_text"]).join(kinds, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def _parsed(ideas: DataFrame, text: str) -> DataFrame:
    """``parse``, row by row."""
    t = tag(ideas, text).drop("roles")
    of_zone = entries_of_zones()
    names = lambda values: F.array(*map(F.lit, values))
    replaced = F.array_compact(F.array(*[F.when(F.arrays_overlap("concepts", names(v)), F.lit(z)) for z, v in of_zone.items()]))
    t = t.withColumn("concepts", F.array_except("concepts", replaced))
    for role in ("entry", "zone", "context", "timing"):
        t = t.withColumn(role, F.array_intersect("concepts", names([c for c, r, _ in CONCEPTS if r == role])))
    bear = F.array_contains("concepts", "MANIP_BEAR")
    t = t.withColumn("entry", F.when(bear, F.array_remove("entry", "MANIP")).otherwise(F.col("entry")))
    low = F.lower(F.col(text))
    macros = [k for c, _, ks in CONCEPTS if c in ("MACRO_SHORT", "MACRO_LONG") for k in ks]
    rest = F.regexp_replace(low, whole_words(macros), "")
    t = t.withColumn("direction", F.when(bear | rest.rlike(r"\bshort\b"), -1).when(rest.rlike(r"\blong\b"), 1).otherwise(0))
    session = reduce(lambda c, x: c.when(F.col(text).rlike(whole_words(x[1])), x[0]), SESSION_WORDS[1:], F.when(F.col(text).rlike(whole_words(SESSION_WORDS[0][1])), SESSION_WORDS[0][0]))
    t = t.withColumn("session", session.otherwise("all"))
    usual = F.get(F.array_intersect("concepts", names([*GAP_ZONES, *BLOCK_ZONES])), F.lit(0))
    by_zone = F.when(usual.isin(*GAP_ZONES), GAP_STOP).when(usual.isNotNull(), F.when(F.col("direction") == 1, 2 * BLOCK_STOP).otherwise(BLOCK_STOP))
    t = t.withColumn("stop", F.coalesce(F.nullif(F.regexp_extract(F.col(text), STOP, 1), F.lit("")).try_cast("double"), by_zone))
    t = t.withColumn("trail", low.rlike(r"\btrail\b"))
    t = t.withColumn("exit_mode", reduce(lambda c, x: c.when(F.col(text).rlike(x[1]), x[0]), EXITS[1:], F.when(F.col(text).rlike(EXITS[0][1]), EXITS[0][0])).otherwise("fixed"))
    both = [*of_zone["OB_SESSION"]]
    more = F.flatten(F.transform("entry", lambda c: reduce(lambda w, x: w.when(c == x[0], names(x[1])), [*of_zone.items(), ("OB_SESSION_HTIEF", both)], F.when(F.lit(False), names(["-"]))).otherwise(F.array().cast("array<string>"))))
    return t.withColumn("concepts", F.array_union("concepts", more))


def gate(ideas: DataFrame, text: str = "idea", most: int = 500) -> DataFrame:
    """``failures``: what is wrong with each text, as an array; empty if it may pass."""
    t = F.coalesce(F.trim(F.col(text)), F.lit(""))
    checks = F.array(
        F.when(F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) < 2, "fewer than two words"), F.when(F.length(t) > most, "too long"),
        F.when(t.rlike(r"[;<>`$\\]"), "blocked characters"), F.when(t.rlike(r"^[0-9\s.,+-]+$"), "only numbers"),
    )
    return ideas.withColumn("failures", F.array_compact(checks))


def known_failures(ideas: DataFrame, failed: DataFrame, text: str = "idea", title: str = "title", pieces: int = 8) -> DataFrame:
    """Ideas that are known to fail: equal to a title, the beginning of one or beginning with one, or with a title anywhere in them.

    A title within an idea starts with the same ``pieces`` characters there, so ideas and titles meet on pieces of that length (shorter titles on
    their own length); an idea that a title begins with meets it on the title's beginning. All are then verified. Case and outer blanks don't count.
    """
    known = failed.select(F.lower(F.trim(title)).alias("_title")).where("_title <> ''").distinct().withColumn("_piece", F.substring("_title", 1, pieces))
    sizes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(pieces)), lambda n: n))
    idea = F.lower(F.trim(F.col(text)))
    one = ideas.distinct().withColumn("_idea", idea)
    spots = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_idea"), F.lit(1))), lambda i: F.transform(sizes, lambda n: F.substring(F.col("_idea"), i, n)))
    inside = one.withColumn("_piece", F.explode(F.array_distinct(F.flatten(spots)))).join(known, "_piece").where(F.contains(F.col("_idea"), F.col("_title")))
    short = known.select("_title", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("_title"), F.lit(pieces))), lambda n: F.substring(F.col("_title"), F.lit(1), n))).alias("_piece"))
    start = one.where("_idea <> ''").withColumn("_piece", F.substring("_idea", 1, pieces)).join(short, "_piece").where(F.startswith(F.col("_title"), F.col("_idea")))
    return inside.select(*ideas.columns).unionByName(start.select(*ideas.columns)).distinct()


def idea_hash(concepts: Column, session: Column, stop: Column, trail: Column) -> Column:
    """Eight hex digits that stand for an idea, whatever the order of its concepts."""
    parts = F.concat_ws("|", F.concat_ws(",", F.array_sort(concepts)), F.coalesce(session, F.lit("")), F.coalesce(stop.cast("string"), F.lit("")), trail.cast("string"))
    return F.substring(F.md5(parts), 1, 8)


def look_alikes(ideas: DataFrame, key: str, text: str = "idea", share: float = 0.8) -> DataFrame:
    """Pairs of ideas with nearly the same words."""
    return fuzzy_duplicates(ideas, key, words_of(F.col(text)), share)


def neighbours(ideas: DataFrame, vocabulary: DataFrame, key: str = "idea_id", most: int = 4, session: str | None = None) -> DataFrame:
    """All ideas one step away, of (key, tokens): without one of several tokens, with one more of the small vocabulary (token) up to ``most``, or, where
    a session column is named, with another session."""
    words = vocabulary.agg(F.array_sort(F.collect_set("token")).alias("_v"))
    i = ideas.crossJoin(F.broadcast(words))  # one row
    here = F.col(session) if session else F.lit(None).cast("string")
    step = lambda name, token, tokens, at: F.struct(F.lit(name).alias("step"), token.alias("token"), tokens.alias("tokens"), at.alias("session"))
    less = F.when(F.size("tokens") > 1, F.transform("tokens", lambda t: step("remove", t, F.array_sort(F.array_remove(F.col("tokens"), t)), here)))
    more = F.when(F.size("tokens") < most, F.transform(F.array_except("_v", "tokens"), lambda t: step("add", t, F.array_sort(F.array_append("tokens", t)), here)))
    none = F.array().cast("array<struct<step: string, token: string, tokens: array<string>, session: string>>")
    parts = [F.coalesce(less, none), F.coalesce(more, none)]
    if session:
        parts.append(F.transform(F.array_except(F.array(*map(F.lit, SESSIONS)), F.array(session)), lambda s: step("session", s, F.array_sort("tokens"), s)))
    out = i.select(key, F.explode(F.concat(*parts)).alias("n")).select(key, "n.*")
    return out if session else out.drop("session")


def best_neighbours(tried: DataFrame, baseline: DataFrame, key: str = "idea_id") -> DataFrame:
    """Of the neighbours tried (key, tokens, score) each idea's best, if it beats the idea's own score in ``baseline`` (key, score)."""
    best = tried.groupBy(key).agg(F.max_by(F.struct("tokens", "score"), F.struct("score", "tokens")).alias("_x")).select(key, "_x.*")
    return best.join(baseline.select(key, F.col("score").alias("_own")), key).where(F.col("score") > F.col("_own")).drop("_own")


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Duplicates removed by key; the row that comes first stays."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def json_numbers(rows: DataFrame, key: str, params: str = "params") -> DataFrame:
    """(key, name, value) of the numbers in a JSON object column; other values are left out."""
    pairs = F.from_json(params, "map<string, string>")
    return rows.select(key, F.explode(pairs).alias("name", "_v")).withColumn("value", F.expr("try_cast(_v AS double)")).where("value is not null").drop("_v")


def count_words(rows: DataFrame, text: str, words: Mapping[str, str]) -> DataFrame:
    """Lines of a log that match each named pattern, in one pass."""
    return rows.agg(*[F.count_if(F.col(text).rlike(p)).alias(n) for n, p in words.items()])
