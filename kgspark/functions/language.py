"""Language detection by stop words and letters, as column expressions; engines with their own scores can be added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent words of each language (fixed values).
PROFILES = {
    "en": "the of and to in a is that it for on was be with as by this are or from at an",
    "fr": "de la le et les des en un une du que est pour dans qui par sur au ne pas il",
    "de": "der die und das den von zu mit sich dem nicht ein eine als auch es auf für ist im",
    "es": "de la el que en y los se del las un por con no una su para es al lo como",
    "it": "di che è la il un a per in non mi si ho lo ma ha le con ti cosa",
    "pt": "de que não o a e um para do eu com é os uma no se na por mais",
}
#: Letters that point to one language (fixed values).
LETTERS = {"de": "äöüß", "fr": "çèêëîïôœùû", "es": "ñ¿¡", "pt": "ãõ"}
#: Scripts that decide on their own (fixed values).
SCRIPTS = {"zh": r"[\x{4E00}-\x{9FFF}]", "ja": r"[\x{3040}-\x{30FF}]", "ko": r"[\x{AC00}-\x{D7AF}]", "ru": r"[\x{0400}-\x{04FF}]", "ar": r"[\x{0600}-\x{06FF}]"}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed a single time."""
    return F.transform(F.array(value), use)[0]


def _among(words: Column, known: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(known)))


def scores(text: Column | str) -> Column:
    """array<struct(prob, lang)>, best first: each language's share of the evidence in the whole text.

    The text is cut into words once, and each language counts those of its profile in a hash set; letters are
    counted by what their deletion leaves, scripts in what is not Latin.
    """
    t = F.lower(F.col(text) if isinstance(text, str) else text)

    def hits(seen: Column) -> Column:
        low, words, other = seen["low"], seen["words"], seen["other"]
        out = []
        for lang, profile in PROFILES.items():
            n = _among(words, profile.split()).cast("double")
            if lang in LETTERS:
                n = n + 2.0 * (F.char_length(low) - F.char_length(F.translate(low, LETTERS[lang], "")))
            out.append(F.struct(n.alias("prob"), F.lit(lang).alias("lang")))
        for lang, script in SCRIPTS.items():
            out.append(F.struct((3.0 * F.when(other == "", 0).otherwise(F.regexp_count(other, F.lit(script)))).alias("prob"), F.lit(lang).alias("lang")))
        return F.array(*out)

    def shares(raw: Column) -> Column:
        total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x["prob"])
        return F.transform(raw, lambda x: F.struct(F.when(total > 0, x["prob"] / total).otherwise(0.0).alias("prob"), x["lang"].alias("lang")))

    cut = _once(t, lambda low: F.struct(low.alias("low"), F.split(low, r"\P{L}+").alias("words"), F.regexp_replace(low, r"[\x{0}-\x{3FF}]+", "").alias("other")))
    return F.sort_array(_once(_once(cut, hits), shares), asc=False)


def detect(text: Column | str) -> Column:
    """struct(lang, confidence); blank texts and texts without evidence are (`unknown`, 0.0)."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    unknown = F.struct(F.lit("unknown").alias("lang"), F.lit(0.0).alias("confidence"))
    return _once(scores(t)[0], lambda b: F.when(b["prob"] > 0, F.struct(b["lang"].alias("lang"), b["prob"].alias("confidence"))).otherwise(unknown))


def detect_top(text: Column | str, k: int = 3) -> Column:
    """The k likeliest languages as array<struct(prob, lang)>, those without evidence left out."""
    return F.slice(F.filter(scores(text), lambda x: x["prob"] > 0), 1, k)


def detect_with(text: Column | str, engines: list[Callable[[Column], Column]], threshold: float = 0.8) -> Column:
    """The first engine's (lang, confidence) if it is confident, else the first other one's that is, else the first's."""
    t = F.col(text) if isinstance(text, str) else text
    found = [engine(t) for engine in engines]
    sure = [F.when(x["confidence"] >= threshold, x) for x in found]
    return F.coalesce(*sure, found[0])


def base_language(code: Column | str) -> Column:
    """`zh-cn` and the like without their region."""
    return F.split_part(F.lower(F.col(code) if isinstance(code, str) else code), F.lit("-"), F.lit(1))


def evaluated(rows: DataFrame, text: str, lang: str, *by: str) -> DataFrame:
    """(by, n, right, accuracy) of detection against the known language `lang`."""
    found = rows.select(*by, (F.col(lang) == detect(text)["lang"]).alias("ok"))
    return found.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("ok").alias("right"), F.round(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)), 6).alias("accuracy"))
