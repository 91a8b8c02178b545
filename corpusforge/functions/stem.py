"""The published English stemmer (Porter 2) as column steps over a table of distinct words.

Every step is one or two projections; a vocabulary is stemmed once and joined back to what uses
its words, so no token is stemmed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published algorithm: suffixes with what takes their place, and words apart.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
APART = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
APART_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
REGION_PREFIX = "^(gener|commun|arsen)"
DOUBLES = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
LI_AFTER = "[cdeghkmnrt]li$"
#: A vowel between consonants at the end (the last not w, x or a consonant y), or a two-letter word of vowel and consonant.
SHORT = "(^[aeiouy][^aeiouy]$)|([^aeiouy][aeiouy][^aeiouywxY]$)"
REGION = "^.*?[aeiouy][^aeiouy]"


def ending(suffixes) -> str:
    """Matches the longest of the suffixes at a word's end."""
    return f"({'|'.join(sorted(suffixes, key=lambda s: (-len(s), s)))})$"


def stems(words: DataFrame, column: str = "term", name: str = "stem") -> DataFrame:
    """words with the stem of each (lower-case words; null stays null)."""
    w, r1, r2, suffix = F.col("_w"), F.col("_r1"), F.col("_r2"), F.col("_s")
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    rest = cut(F.length(suffix))
    inside = lambda region: F.length(w) - F.length(suffix) >= region

    def step(df: DataFrame, suffixes, to: Column) -> DataFrame:
        """One step: _s is the longest suffix that the word ends in, to its new form."""
        return df.withColumn("_s", F.regexp_extract(w, ending(suffixes), 1)).withColumn("_w", F.when((suffix == "") | F.col("_kept"), w).otherwise(to))

    bare = F.regexp_replace(F.col(column), "^'", "")
    df = words.withColumn("_w", F.regexp_replace(F.regexp_replace(bare, "^y", "Y"), "([aeiouy])y", "$1Y"))
    prefix, first = F.regexp_extract(w, REGION_PREFIX, 0), F.regexp_extract(w, REGION, 0)
    df = df.withColumn("_r1", F.when(prefix != "", F.length(prefix)).when(first != "", F.length(first)).otherwise(F.length(w)))
    second = F.regexp_extract(F.substring(w, r1 + 1, F.length(w)), REGION, 0)
    df = df.withColumn("_r2", F.when(second != "", r1 + F.length(second)).otherwise(F.length(w))).withColumn("_kept", F.lit(False))
    df = df.withColumn("_w", F.regexp_replace(w, "('s'|'s|')$", ""))
    df = step(df, ("sses", "ied", "ies", "us", "ss", "s"), F.when(suffix == "sses", cut(2)).when(suffix.isin("ied", "ies"), cut(F.when(F.length(w) > 4, 2).otherwise(1))).when((suffix == "s") & w.rlike("[aeiouy].+s$"), cut(1)).otherwise(w))
    df = df.withColumn("_kept", w.isin(*APART_1A))
    e = ("eed", "eedly")
    df = step(df, (*e, "ed", "edly", "ing", "ingly"), F.when(suffix.isin(*e), F.when(inside(r1), F.concat(rest, F.lit("ee"))).otherwise(w)).when(rest.rlike("[aeiouy]"), F.concat(rest, F.lit("\t"))).otherwise(w))
    # A word that lost its ending carries a tab until its new end is mended.
    trimmed = F.substring(w, F.lit(1), F.length(w) - 1)
    mended = F.when(trimmed.rlike("(at|bl|iz)$"), F.concat(trimmed, F.lit("e"))).when(trimmed.rlike(DOUBLES), cut(2)).when(trimmed.rlike(SHORT) & (r1 >= F.length(trimmed)), F.concat(trimmed, F.lit("e"))).otherwise(trimmed)
    df = df.withColumn("_w", F.when(w.endswith("\t"), mended).otherwise(w))
    df = df.withColumn("_w", F.when(F.col("_kept"), w).otherwise(F.regexp_replace(w, "(.[^aeiouy])[yY]$", "$1i")))
    of = lambda table: F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), suffix)
    allowed = F.when(suffix == "ogi", w.rlike("logi$")).when(suffix == "li", w.rlike(LI_AFTER)).otherwise(True)
    df = step(df, STEP_2, F.when(inside(r1) & allowed, F.concat(rest, of(STEP_2))).otherwise(w))
    df = step(df, STEP_3, F.when(inside(F.when(suffix == "ative", r2).otherwise(r1)), F.concat(rest, of(STEP_3))).otherwise(w))
    df = step(df, STEP_4, F.when(inside(r2) & ((suffix != "ion") | w.rlike("[st]ion$")), rest).otherwise(w))
    df = step(df, ("e", "l"), F.when((suffix == "e") & (inside(r2) | (inside(r1) & ~rest.rlike(SHORT))), rest).when((suffix == "l") & inside(r2) & w.rlike("ll$"), rest).otherwise(w))
    apart = F.element_at(F.create_map(*(F.lit(x) for pair in APART.items() for x in pair)), F.col(column))
    out = F.when(F.length(column) <= 2, F.col(column)).otherwise(F.coalesce(apart, F.translate(w, "Y", "y")))
    return df.withColumn(name, out).drop("_w", "_r1", "_r2", "_s", "_kept")


def stems_sql(words: str, name: str = "stems") -> str:
    """CTEs in DuckDB: `name` (term, stem) of the words in `words` (term)."""
    rest = "substr(w, 1, length(w) - length(s))"
    inside = lambda region: f"length(w) - length(s) >= {region}"
    table = lambda t: "CASE s " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items()) + " END"
    out, last = [], f"{name}_0"
    out.append(f"{name}_a AS (SELECT term, regexp_replace(regexp_replace(regexp_replace(term, '^''', ''), '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {words})")
    out.append(f"{name}_b AS (SELECT *, CASE WHEN regexp_extract(w, '{REGION_PREFIX}') <> '' THEN length(regexp_extract(w, '{REGION_PREFIX}')) WHEN regexp_extract(w, '{REGION}') <> '' THEN length(regexp_extract(w, '{REGION}')) ELSE length(w) END AS r1 FROM {name}_a)")
    out.append(f"{last} AS (SELECT term, r1, CASE WHEN regexp_extract(substr(w, r1 + 1), '{REGION}') <> '' THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{REGION}')) ELSE length(w) END AS r2, false AS kept, regexp_replace(w, '(''s''|''s|'')$', '') AS w FROM {name}_b)")

    def step(k: int, suffixes, to: str, kept: str = "kept") -> None:
        nonlocal last
        out.append(f"{name}_{k} AS (SELECT term, r1, r2, {kept} AS kept, w FROM (SELECT term, r1, r2, kept, CASE WHEN s = '' OR kept THEN w ELSE {to} END AS w FROM (SELECT *, regexp_extract(w, '{ending(suffixes)}') AS s FROM {last})))")
        last = f"{name}_{k}"

    step(1, ("sses", "ied", "ies", "us", "ss", "s"), "CASE WHEN s = 'sses' THEN substr(w, 1, length(w) - 2) WHEN s IN ('ied', 'ies') THEN substr(w, 1, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END) WHEN s = 's' AND regexp_matches(w, '[aeiouy].+s$') THEN substr(w, 1, length(w) - 1) ELSE w END", f"w IN {APART_1A}")
    step(2, ("eed", "eedly", "ed", "edly", "ing", "ingly"), f"CASE WHEN s IN ('eed', 'eedly') THEN CASE WHEN {inside('r1')} THEN {rest} || 'ee' ELSE w END WHEN regexp_matches({rest}, '[aeiouy]') THEN CASE WHEN regexp_matches({rest}, '(at|bl|iz)$') THEN {rest} || 'e' WHEN regexp_matches({rest}, '{DOUBLES}') THEN substr({rest}, 1, length({rest}) - 1) WHEN regexp_matches({rest}, '{SHORT}') AND r1 >= length({rest}) THEN {rest} || 'e' ELSE {rest} END ELSE w END")
    step(3, ("y", "Y"), "regexp_replace(w, '(.[^aeiouy])[yY]$', '\\1i')")
    step(4, STEP_2, f"CASE WHEN {inside('r1')} AND CASE s WHEN 'ogi' THEN regexp_matches(w, 'logi$') WHEN 'li' THEN regexp_matches(w, '{LI_AFTER}') ELSE true END THEN {rest} || {table(STEP_2)} ELSE w END")
    step(5, STEP_3, f"CASE WHEN {inside(chr(40) + 'CASE s WHEN ' + chr(39) + 'ative' + chr(39) + ' THEN r2 ELSE r1 END' + chr(41))} THEN {rest} || {table(STEP_3)} ELSE w END")
    step(6, STEP_4, f"CASE WHEN {inside('r2')} AND (s <> 'ion' OR regexp_matches(w, '[st]ion$')) THEN {rest} ELSE w END")
    step(7, ("e", "l"), f"CASE WHEN s = 'e' AND ({inside('r2')} OR {inside('r1')} AND NOT regexp_matches({rest}, '{SHORT}')) THEN {rest} WHEN s = 'l' AND {inside('r2')} AND regexp_matches(w, 'll$') THEN {rest} ELSE w END")
    apart = "CASE term " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in APART.items()) + " END"
    out.append(f"{name} AS (SELECT term, CASE WHEN length(term) <= 2 THEN term ELSE coalesce({apart}, replace(w, 'Y', 'y')) END AS stem FROM {last})")
    return ",\n".join(out)
