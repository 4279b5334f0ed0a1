"""Text expressions: prefix slicing, whole-value recode, score adverbs, row
descriptions, reply texts, reply flags and search links. All are column
expressions (no Python UDF)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the application's for equal results) ---------
# Genre codes spelt out in full.
GENRE_NAMES = {
    "blu": "blues", "cla": "classical", "cou": "country", "dis": "disco",
    "hip": "hiphop", "jaz": "jazz", "met": "metal", "reg": "reggae", "roc": "rock",
}
# Mood clusters to their undertone words (each ends with ", ").
MIREX_UNDERTONES = {
    "cluster1": "passionate, rousing, confident, boisterous, rowdy, ",
    "cluster2": "rollicking, cheerful, fun, sweet, amiable, ",
    "cluster3": "literate, poignant, wistful, bittersweet, autumnal, brooding, ",
    "cluster4": "humorous, silly, campy, quirky, whimsical, witty, wry, ",
    "cluster5": "aggressive, fiery, anxious, intense, volatile, visceral, ",
}
# Score thresholds and their adverbs (value < bound), the last one otherwise.
ADVERB_BOUNDS = [(0.25, "not "), (0.5, "not very "), (0.75, "quite ")]
ADVERB_ELSE = "extremely "
# Description template pieces.
DESCRIPTION_SCORES = [
    ("dance", "dance"), ("acoustic", "acoustic"), ("aggressive", "aggressive"),
    ("electronic", "electronic"), ("happy", "happy"), ("party", "party"),
    ("relaxed", "relaxed"), ("sad", "sad"), ("timbre", "bright"), ("tonal", "tonal"),
    ("voice", "voice"),
]
# Reply texts.
RECOMMEND_ITEM = "- {name} by {artist}"
RECOMMEND_EXHAUSTED = "Please give us a new description!"
RECOMMEND_NONE = "No more results, please give us a new description!"
SEARCH_ITEM = "Here's our closest song: {name} by {artist}. Click again if this isn't it!"
SEARCH_EXHAUSTED = "We might not have the song you're looking for. Try another song?"
SEARCH_NONE = "We might not have this song in our database! Please try a different song."
REPLY_FALLBACK = "No result, try another prompt?"
# Search sites a reply links to.
LINK_PREFIXES = {
    "youtube": "https://www.youtube.com/results?search_query=",
    "spotify": "https://open.spotify.com/search/",
    "google": "https://www.google.com/search?q=",
}
# Characters encodeURI leaves as they are, besides letters, digits and -_.!~*'()
URI_RESERVED = ";,/?:@&=+$#"
# ---------------------------------------------------------------------------


def prefix(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)


def year_prefix(s: Column) -> Column:
    """Leading 4 characters as int; null (not an error) when not a number."""
    return prefix(s, 4).try_cast("int")


def recode(c: Column, mapping: Mapping[str, str]) -> Column:
    """Whole-value replacement; values not in the map pass unchanged."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.try_element_at(m, c), c)


def adverb(v: Column) -> Column:
    """Score to adverb. NaN and null fall to the last branch, as in the
    reference's if/elif chain (NaN compares false)."""
    out = None
    for bound, word in ADVERB_BOUNDS:
        cond = v < F.lit(bound)
        out = F.when(cond, F.lit(word)) if out is None else out.when(cond, F.lit(word))
    return out.otherwise(F.lit(ADVERB_ELSE))


def description(name: Column, artist: Column, year: Column, gender: Column,
                genre: Column, mirex: Column, scores: Mapping[str, Column]) -> Column:
    """The synthetic row description; ``genre``/``mirex`` already recoded."""
    parts = [
        F.lit("This song is "), name, F.lit(", sung by "), artist, F.lit(" in "),
        year.cast("string"), F.lit(". Sung by a "), gender,
        F.lit(". Likely falls into the "), genre,
        F.lit(" genre. Has the following undertones: "), mirex, F.lit(" "),
    ]
    for col, label in DESCRIPTION_SCORES:
        parts += [adverb(scores[col]), F.lit(label + ",")]
    parts.append(F.when(scores["voice"] < F.lit(0.5), F.lit("instrumental")).otherwise(F.lit("vocal")))
    return F.concat(*parts)


def describe(df, name="name", artist="artist", year="year", gender="gender",
             genre="genre", mirex="mirex") -> Column:
    return description(
        F.col(name), F.col(artist), F.col(year), F.col(gender),
        recode(F.col(genre), GENRE_NAMES), recode(F.col(mirex), MIREX_UNDERTONES),
        {c: F.col(c) for c, _ in DESCRIPTION_SCORES},
    )


def recommend_item(name: Column, artist: Column) -> Column:
    return F.concat(F.lit("- "), name, F.lit(" by "), artist)


def search_item(name: Column, artist: Column) -> Column:
    return F.concat(F.lit("Here's our closest song: "), name, F.lit(" by "), artist,
                    F.lit(". Click again if this isn't it!"))


def reply_text(reply: Column) -> Column:
    """What the page shows: the reply, or the fallback when empty/missing."""
    return F.coalesce(F.nullif(reply, F.lit("")), F.lit(REPLY_FALLBACK))


def reply_valid(reply: Column) -> Column:
    """Whether links and the add button are shown."""
    return (F.coalesce(reply, F.lit("")) != F.lit("")) & (
        F.coalesce(reply, F.lit("")) != F.lit(RECOMMEND_EXHAUSTED))


def encode_uri(s: Column) -> Column:
    """JavaScript ``encodeURI``: UTF-8 percent-encoding that keeps letters,
    digits, ``-_.!~*'()`` and the URI reserved set."""
    out = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    for ch in URI_RESERVED + "!~'()*":
        out = F.replace(out, F.lit("%%%02X" % ord(ch)), F.lit(ch))
    return out


def duck_encode_uri(expr: str) -> str:
    out = f"url_encode({expr})"
    for ch in URI_RESERVED + "!~'()*":
        lit = ch.replace("'", "''")
        out = f"replace({out}, '%{ord(ch):02X}', '{lit}')"
    return out


def links(reply: Column) -> dict[str, Column]:
    enc = encode_uri(reply)
    return {site: F.concat(F.lit(p), enc) for site, p in LINK_PREFIXES.items()}


def duck_recode(expr: str, mapping: Mapping[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"(CASE {expr} {cases} ELSE {expr} END)"


def duck_adverb(expr: str) -> str:
    whens = " ".join(f"WHEN {expr} < {b} THEN '{w}'" for b, w in ADVERB_BOUNDS)
    return f"(CASE {whens} ELSE '{ADVERB_ELSE}' END)"


def duck_description(alias: str = "") -> str:
    a = alias + "." if alias else ""
    pieces = [
        "'This song is '", f"{a}name", "', sung by '", f"{a}artist", "' in '",
        f"CAST({a}year AS VARCHAR)", "'. Sung by a '", f"{a}gender",
        "'. Likely falls into the '", duck_recode(f"{a}genre", GENRE_NAMES),
        "' genre. Has the following undertones: '", duck_recode(f"{a}mirex", MIREX_UNDERTONES), "' '",
    ]
    for col, label in DESCRIPTION_SCORES:
        pieces += [duck_adverb(f"{a}{col}"), f"'{label},'"]
    pieces.append(f"(CASE WHEN {a}voice < 0.5 THEN 'instrumental' ELSE 'vocal' END)")
    return "(" + " || ".join(pieces) + ")"


def first_of(arr: Column) -> Column:
    """First element or null (``arr[0]`` raises on empty under ANSI)."""
    return F.get(arr, 0)


def cast_group(cols: Sequence[str], type_name: str) -> list[Column]:
    return [F.col(c).cast(type_name).alias(c) for c in cols]
