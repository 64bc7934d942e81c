"""Text expressions: tokens, stems, stop words, keys, labels and slugs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words (the classic 127-word list) and the words that
# describe the list feature itself.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did doing
a an the and but if or because as until while of at by for with about against between into
through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now
""".split()
DOMAIN_STOP_WORDS = ["Twitter", "List", "Formulist", "Follow", "Follow-back"]

STOP_WORDS = ENGLISH_STOP_WORDS + [w.lower() for w in DOMAIN_STOP_WORDS]

HANDLE = r"(?<![A-Za-z0-9_])@\w+"
ENTITY = r"&(amp|lt|gt|quot|apos|nbsp|#39);"
CAMEL = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
HAS_CAMEL = "[a-z][A-Z]|[A-Z][A-Z][a-z]"
NON_WORD = r"[\W_]+"


def _not_empty(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def _replace_if(text: Column, mark: str, pattern: str) -> Column:
    """Replace by a blank; texts without the mark skip the pattern."""
    return F.when(F.contains(text, F.lit(mark)), F.regexp_replace(text, pattern, " ")).otherwise(text)


def camel_split(text: Column) -> Column:
    """Array of the camelCase pieces of one identifier."""
    return _not_empty(F.split(text, CAMEL))


def raw_tokens(text: Column) -> Column:
    """Array of words: handles dropped, camelCase opened, split at anything but letters and digits."""
    cleaned = _replace_if(_replace_if(text, "@", HANDLE), "&", ENTITY)
    # the costlier split runs only on texts that hold a camelCase boundary
    opened = F.when(cleaned.rlike(HAS_CAMEL), F.split(cleaned, f"{NON_WORD}|{CAMEL}"))
    return _not_empty(opened.otherwise(F.split(cleaned, NON_WORD)))


def stem(token: Column) -> Column:
    """Default stemmer: plural endings only, for words longer than three letters.

    ``ies`` turns into ``y`` (not after a or e), else the s goes, except after u, s and in aes, ees, oes.
    """
    n = F.length(token)

    def ends(*endings: str) -> Column:
        return reduce(lambda a, b: a | b, [F.endswith(token, F.lit(e)) for e in endings])

    return (
        F.when(~ends("s") | (n <= 3), token)
        .when(ends("ies") & ~ends("aies", "eies"), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
        .when(ends("es") & ~ends("aes", "ees", "oes"), F.substring(token, F.lit(1), n - 1))
        .when(~ends("us", "ss"), F.substring(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def drop_stop_words(tokens: Column) -> Column:
    """Lower-cased, stemmed words; a word goes if it or its stem is a stop word."""
    words = F.filter(F.transform(tokens, F.lower), lambda t: ~t.isin(STOP_WORDS))
    return F.filter(F.transform(words, stem), lambda t: ~t.isin(STOP_WORDS))


def topic_tokens(text: Column) -> Column:
    """Array of lower-cased, stemmed words with the stop words removed."""
    return drop_stop_words(raw_tokens(text))


def bigrams(tokens: Column) -> Column:
    """Array of neighbouring pairs joined by a space (empty below two tokens)."""

    def pairs(t: Column) -> Column:
        joined = F.zip_with(t, F.slice(t, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.filter(joined, lambda p: p.isNotNull())

    # the one-element wrapper makes Spark build the tokens once, not once per use
    return F.get(F.transform(F.array(tokens), pairs), F.lit(0))


def query_vector(query: Column) -> Column:
    """Trimmed, tokenised, lower-cased, stemmed and re-joined query text."""
    return F.array_join(F.transform(raw_tokens(F.trim(query)), lambda t: stem(F.lower(t))), " ")


def blank_cleaned(text: Column) -> Column:
    """Lower case, reduced to letters, digits and blanks."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N} ]+", ""))


def blank_separated(text: Column) -> Column:
    """Lower-cased tokens between single blanks, reduced to letters and digits; positions are kept."""
    return F.split(blank_cleaned(text), " ")


def namespaced(*parts: Column) -> Column:
    """``site:key`` style key."""
    return F.concat_ws(":", *parts)


def key_part(key: Column, index: int) -> Column:
    """Part of a namespaced key, counted from 0 (negative from the end); NULL if missing."""
    return F.try_element_at(F.split(key, ":"), F.lit(index + 1 if index >= 0 else index))


def rekey(key: Column, namespace: str) -> Column:
    """Move a key to another namespace, keeping its last part."""
    return F.concat(F.lit(namespace + ":"), key_part(key, -1))


def topic_label(site: Column, tag: Column) -> Column:
    """First label of the site and the tag: ``gis.example.com`` + ``qgis`` gives ``gis qgis``."""
    return F.concat_ws(" ", F.try_element_at(F.split(site, r"\."), F.lit(1)), tag)


def normal_label(label: Column) -> Column:
    """Lower case, dashes read as spaces."""
    return F.replace(F.lower(label), F.lit("-"), F.lit(" "))


def topic_slug(topic: Column) -> Column:
    """URL form of a topic: commas vanish; blanks, dots and slashes become dashes."""
    return F.translate(topic, " ./,", "---")


def slug_topic(slug: Column) -> Column:
    """Dashes back to blanks."""
    return F.replace(slug, F.lit("-"), F.lit(" "))


def profile_slug(name: Column) -> Column:
    """Blanks of a person's name joined by dashes."""
    return F.array_join(F.split(name, " "), "-")


def like_literal(text: str) -> str:
    """Escape the wildcards of user input for use inside a LIKE pattern."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
