"""Text scalars: normalisation, domains, phones, wikitext, snippets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second-level labels under which a registration takes three labels (fixed values).
SECOND_LEVEL = ["co", "com", "net", "org", "gov", "ac", "edu", "ne", "or", "go", "gob", "nic", "mil"]
#: What may stand before a phone number to say that it is one (fixed values).
PHONE_WORDS = ["telephone", "tel", "phone", "ph", "t"]


class _Folds(dict):
    """Code point to what it folds to, worked out when first met: compatible and small letters without their marks, and a space for all that is no letter or digit."""

    def __missing__(self, point: int) -> str:
        apart = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", chr(point)).casefold())
        self[point] = found = "".join(c if c.isalnum() else " " for c in apart if not unicodedata.combining(c))
        return found


_FOLDS = _Folds()


def normalise(text: str | None) -> str | None:
    """Letters and digits only, folded one by one, one space between words."""
    return None if text is None else " ".join(text.translate(_FOLDS).split())


def norm(column) -> Column:
    """``normalise`` as an Arrow-batched function; Spark has no decomposition of its own, so keep its result in a column."""
    return F.pandas_udf(lambda s: s.map(normalise), "string")(column)


def norm_latin(column) -> Column:
    """The same for texts of Latin-1 letters, without Python: lower case, accents mapped, other runs to one space."""
    plain = F.translate(F.regexp_replace(F.lower(column), "ß", "ss"), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(plain, "[^0-9a-z]+", " "))


def ascii_label(column) -> Column:
    return F.regexp_replace(F.lower(column), "[^a-z0-9]", "")


def label_right(guess, truth) -> Column:
    """Lenient equality: equal, or one contains the other; null without a truth, false without a guess."""
    g, t = ascii_label(guess), ascii_label(truth)
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("boolean")).otherwise(F.coalesce((g != "") & ((g == t) | g.contains(t) | t.contains(g)), F.lit(False)))


def host_labels(url) -> Column:
    """The labels of a URL's host (or of a bare host), without a leading www; null where it is no host name."""
    rest = F.regexp_replace(F.lower(F.trim(url)), "^[a-z][-+.a-z0-9]*://", "")
    labels = F.split(F.element_at(F.split(rest, "[/?#:]"), 1), "[.]")
    www = (F.size(labels) > 2) & F.element_at(labels, 1).rlike("^www[0-9]?$")
    labels = F.when(www, F.slice(labels, F.lit(2), F.size(labels) - 1)).otherwise(labels)
    spelled = F.forall(labels, lambda x: x.rlike("^[-a-z0-9]+$"))
    return F.when(spelled & (F.size(labels) > 1) & F.element_at(labels, -1).rlike("^[a-z][a-z]+$"), labels)


def domain(url, tlds: list[str] | None = None) -> Column:
    """The registrable domain of a URL or host, else null; with ``tlds``, only hosts that end in one of them."""
    labels = host_labels(url)
    last = F.element_at(labels, -1)
    second = (F.length(last) == 2) & F.element_at(labels, -2).isin(*SECOND_LEVEL)
    keep = F.least(F.size(labels), F.when(second, 3).otherwise(2))
    found = F.array_join(F.slice(labels, F.size(labels) - keep + 1, keep), ".")
    return F.when(labels.isNotNull() & (last.isin(*tlds) if tlds is not None else F.lit(True)), found)


def phone(text) -> Column:
    """Digits, with a plus sign where ``+`` or ``00`` comes first; null unless nothing but a phone word, digits and separators is there, and 7 to 15 digits."""
    said = F.regexp_replace(F.lower(F.trim(text)), "^(" + "|".join(PHONE_WORDS) + r")\b[.]?", "")
    number = F.translate(said, " \t()-./:", "")
    plus = number.startswith("+")
    digits = F.when(plus, F.substr(number, F.lit(2))).otherwise(number)
    ok = digits.rlike("^[0-9]+$") & F.length(digits).between(7, 15)
    foreign = ~plus & digits.startswith("00")
    return F.when(ok, F.concat(F.when(plus | foreign, "+").otherwise(""), F.when(foreign, F.substr(digits, F.lit(3))).otherwise(digits)))


def strip_tags(column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(column, r"<[^>]*>", " "), r"\s+", " "))


def strip_wikitext(column) -> Column:
    """Templates (three nested passes), tables, references, files, links, markup."""
    x = F.regexp_replace(column, r"(?s)<!--.*?-->|<ref[^>/]*/>|<ref.*?</ref>", "")
    for _ in range(3):
        x = F.regexp_replace(x, r"\{\{[^{}]*\}\}", "")
    x = F.regexp_replace(x, r"(?s)\{\|.*?\|\}", "")
    x = F.regexp_replace(x, r"(?i)\[\[(?:file|image|category):[^\[\]]*(?:\[\[[^\]]*\]\][^\[\]]*)*\]\]", "")
    x = F.regexp_replace(x, r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    x = F.regexp_replace(x, r"\[https?://\S+ ?([^\]]*)\]", "$1")
    x = F.regexp_replace(x, r"'{2,}|<[^>]+>", "")
    x = F.regexp_replace(x, r"(?m)^=+\s*(.*?)\s*=+$", "$1")
    return F.trim(F.regexp_replace(x, r"\n{2,}", "\n"))


def passages(text, size: int = 700, most: int | None = None) -> Column:
    """Lines (or the sentences of a text of one long line) gathered, in order, into passages of up to ``size`` characters; a longer unit is one by itself.

    A passage's units are joined by line feeds, and all of the text is taken unless ``most`` cuts
    it.  An expression: a fold over the units whose state is the finished passages and the open one.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))
    whole = whole if most is None else F.substring(whole, 1, most)
    tidy = lambda units: F.filter(F.transform(units, lambda u: F.regexp_replace(u, r"^\s+|\s+$", "")), lambda u: u != "")
    lines = F.split(whole, r"\n+")
    sentences = F.split(F.element_at(lines, 1), r"(?<=[.!?。])\s+")
    units = tidy(F.when((F.size(lines) == 1) & (F.length(F.element_at(lines, 1)) > size), sentences).otherwise(lines))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state, unit):
        full = (state.now != "") & (F.length(state.now) + F.length(unit) > size)
        done = F.when(full, F.concat(state.done, F.array(state.now))).otherwise(state.done)
        now = F.when(full | (state.now == ""), unit).otherwise(F.concat(state.now, F.lit("\n"), unit))
        return F.struct(done.alias("done"), now.alias("now"))

    return F.aggregate(units, start, step, lambda state: F.when(state.now == "", state.done).otherwise(F.concat(state.done, F.array(state.now))))


def snippet(body, words, width: int = 200) -> Column:
    """A window that starts a third before the first of ``words`` (an array), with ellipses where text is cut."""
    low = F.lower(body)
    at = F.array_min(F.filter(F.transform(words, lambda w: F.instr(low, w)), lambda i: i > 0))
    start = F.greatest(F.lit(0), F.coalesce(at, F.lit(1)) - 1 - width // 3)
    cut = F.trim(F.regexp_replace(F.substr(body, start + 1, F.lit(width)), r"\s+", " "))
    return F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(start + width < F.length(body), "…").otherwise(""))


def first_sentence(column, least: int = 60, else_chars: int = 300) -> Column:
    found = F.regexp_extract(column, rf"(?s)^(.{{{least},}}?[.!?])(?:\s|$)", 1)
    return F.when(found != "", found).otherwise(F.substring(column, 1, else_chars))


def last_latlon(column) -> Column:
    """The last ``lat, lon`` pair of numbers in a text, in range, as a struct; else null."""
    number = r"(-?\d{1,3}(?:\.\d+)?)"
    pair = F.try_element_at(F.regexp_extract_all(column, F.lit(rf"{number}\s*,\s*{number}"), F.lit(0)), F.lit(-1))
    lat = F.regexp_extract(pair, r"^(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    lon = F.regexp_extract(pair, r",\s*(-?\d+(?:\.\d+)?)$", 1).try_cast("double")
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def words_of(column) -> Column:
    """The words of a normalised text; none for an empty one."""
    return F.filter(F.split(column, " "), lambda w: w != "")


def grams(words, most: int = 3) -> Column:
    """All runs of 1 to ``most`` words, in order of length, then place."""

    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(*[of(n) for n in range(1, most + 1)])


def series_map(fn, returns: str):
    """A row function as an Arrow-batched one."""
    return F.pandas_udf(lambda s: pd.Series([fn(x) for x in s]), returns)
