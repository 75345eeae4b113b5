"""Column functions: similarity scores, titles, labels. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def day(seconds: Column) -> Column:
    """UTC calendar day of unix seconds, as yyyy-MM-dd; doesn't depend on the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")


def seconds(ts: Column) -> Column:
    """Whole unix seconds of a timestamp without time zone, taken as UTC; the session's time zone plays no part."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def eligible() -> Column:
    """Contributions that count as votes."""
    return (F.col("poison_check") == "pass") & (F.col("match_confidence") >= S.MIN_CONFIDENCE) & (F.col("match_source") != S.NETWORK_DISC)


def same_episode(a: str, b: str) -> Column:
    """Null-safe equality of the episode keys of the aliases a and b."""
    out = F.lit(True)
    for k in S.EPISODE:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def tier(voters: Column, mean: Column, tainted: Column) -> Column:
    """The mean is compared after rounding to 12 digits, so that the order in which it was summed decides nothing."""
    return (
        F.when((voters >= 3) & (F.round(mean, 12) >= S.CANONICAL_CONFIDENCE) & ~tainted, "canonical").when(voters >= 2, "confirmed").otherwise("candidate")
    )


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def combined_score(overlap: Column, temporal: Column, rarity: Column) -> Column:
    return clamp01(S.W_RARITY * rarity + S.W_OVERLAP * overlap + S.W_TEMPORAL * temporal)


def idf(n_documents: Column, df: Column) -> Column:
    return F.log((n_documents + 1) / (F.coalesce(df, F.lit(1)) + 1)) + 1


def exact_overlap(query: Column, reference: Column) -> Column:
    """Share of the query's elements, repeats counted, that the reference has; 0 for an empty query. For single pairs."""
    n = F.size(query)
    return F.when(n > 0, F.size(F.filter(query, lambda x: F.array_contains(reference, x))) / n).otherwise(F.lit(0.0))


def jaccard_estimate(a: Column, b: Column) -> Column:
    """Share of equal slots of two sketches (arrays of 128)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / 128


def fmix32(x: Column) -> Column:
    """Murmur3's 32-bit finaliser on a bigint column of unsigned 32-bit values; split products keep within 64 bits."""
    mask = F.lit(0xFFFFFFFF)

    def times(v: Column, c: int) -> Column:
        high = F.shiftright(v, 16) * c
        return ((high.bitwiseAND(F.lit(0xFFFF)) * 65536) + v.bitwiseAND(F.lit(0xFFFF)) * c).bitwiseAND(mask)

    x = x.bitwiseXOR(F.shiftright(x, 16))
    x = times(x, 0x85EBCA6B)
    x = x.bitwiseXOR(F.shiftright(x, 13))
    x = times(x, 0xC2B2AE35)
    return x.bitwiseXOR(F.shiftright(x, 16))


def hash32(s: Column) -> Column:
    """The first eight hexadecimal digits of the MD5, as a number."""
    return F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("long")


def strict_base64(s: Column) -> Column:
    """Decoded bytes; null for anything malformed."""
    return F.when(s.rlike(S.BASE64), F.try_to_binary(s, F.lit("base64")))


def base64url(s: Column) -> Column:
    standard = F.translate(s, "-_", "+/")
    return F.try_to_binary(F.rpad(standard, F.length(s) + F.pmod(-F.length(s), F.lit(4)), "="), F.lit("base64"))


def to_base64(raw: Column) -> Column:
    """Base64 in one line (the built-in function breaks it every 76 characters)."""
    return F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))


def sorted_titles(titles: Column) -> Column:
    return F.array_sort(titles, lambda a, b: (a["title_index"] - b["title_index"]).cast("int"))


def titles_json(titles: Column) -> Column:
    """The titles in index order with all eight fields."""
    return F.to_json(sorted_titles(titles), {"ignoreNullFields": "false"})


def titles_digest(titles: Column) -> Column:
    """SHA-256 of the titles' identity: index, assignment, season and episode, in index order."""
    identity = F.transform(sorted_titles(titles), lambda t: F.struct(*[t[k].alias(k) for k in ("title_index", "assignment", "season", "episode")]))
    return F.sha2(F.to_json(identity, {"ignoreNullFields": "false"}), 256)


def parse_titles(json: Column) -> Column:
    """Titles of a JSON text; null if it is malformed or not a list."""
    return F.from_json(json, f"array<{S.TITLE.simpleString()}>")


def mean_title_confidence(titles: Column) -> Column:
    """Mean over the titles, 0 for none."""
    total = F.aggregate(titles, F.lit(0.0), lambda s, t: s + t["match_confidence"])
    return F.when(F.size(titles) > 0, total / F.size(titles)).otherwise(F.lit(0.0))


def from_network(titles: Column) -> Column:
    return F.exists(titles, lambda t: t["match_source"] == S.NETWORK_DISC)


def clamped_k(text: Column) -> Column:
    """Number of candidates that a request asks for: as ``schema.clamp_k`` of the number in the text, 5 without one."""
    k = text.try_cast("double")
    bad = k.isNull() | F.isnan(k) | (F.abs(k) == float("inf")) | (k <= 0)
    return F.when(bad, 5).otherwise(F.floor(F.greatest(F.lit(1.0), F.least(F.lit(20.0), k)))).cast("int")


def redacted(pseudonym: Column) -> Column:
    return F.substring(pseudonym, 1, 8)


def share(x: Column, denominator: Column) -> Column:
    return x / F.greatest(F.lit(1), denominator)


def episode_label(season: Column, episode: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), F.greatest(F.lit(2), F.length(c.cast("string"))), F.lit("0"))
    return F.when(season.isNull(), "—").otherwise(F.concat(F.lit("S"), two(season), F.lit("E"), F.coalesce(two(episode), F.lit("—"))))


def relative_time(at: Column, asof: Column) -> Column:
    """Age in s, m, h or d; the date past thirty days, a dash for none."""
    age = F.greatest(F.lit(0), asof - at)
    whole = lambda n: F.floor(age / n).cast("string")
    return (
        F.when(at.isNull() | (at == 0), "—")
        .when(age < 60, F.concat(age.cast("string"), F.lit("s ago")))
        .when(age < 3600, F.concat(whole(60), F.lit("m ago")))
        .when(age < 86400, F.concat(whole(3600), F.lit("h ago")))
        .when(age < 30 * 86400, F.concat(whole(86400), F.lit("d ago")))
        .otherwise(day(at))
    )


def escape_html(s: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def show_name(name: Column, tmdb_id: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("tmdb:"), tmdb_id.cast("string")))
