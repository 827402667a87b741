"""One form for text that looks the same: look-alike mapping and Unicode collation, in SQL expressions.

``skeleton`` maps width forms, blanks, invisible characters and characters that share a shape, one for one
wherever possible; what it leaves apart (composed and decomposed marks, compatibility ideographs of equal
meaning) the collation ``UNICODE`` joins: it is sensitive to case, marks, small kana and punctuation. Values
are grouped under it, each class gets a canonical member, and that is joined back to the rows. Everything
runs in the JVM.

Collated values can only be sorted, at the price of a collator's comparison each. So they are first grouped by
their base, a plain text that is equal wherever the collation finds skeletons equal, with two hashes to tell
whether a group holds more than one value. Only rows of those groups are collated and joined.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tanzaku.checkpoints import stored

#: Letters to which the Unicode list of confusables gives the shape of a Latin letter of the same case.
LATIN_SHAPES = {
    "АВЕЅІЈКМНОРСТХУѴҮӀԌԜ": "ABESIJKMHOPCTXYVYIGW", "аеорсухѕіјһԁԛԝѵӏ": "aeopcyxsijhdqwvl",
    "ͿΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜϺ": "JABEZHIKMNOPTYXFM", "οινυρϳ": "oivupj",
    "ՍՏՕ": "USO", "հոսօցզ": "hnuogq",
    "ᎠᎡᎢᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏳᏴ": "DRTYAJEWMHYGZRWSVSLCPKGB", "ꭵꮁꮃꮓꮩꮪꮯ": "irwzvsc",
    "ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⳐ": "HIKMNOPCTYXL", "ⲟⲣⲥ": "opc",
    "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPdDTGKJCZFMNLSRVHWXYAElOU",
    "ɑɡıᴄᴏᴠᴡᴢꜱ": "agicovwzs",
}
#: Ideographs, kana and marks that share a shape.
CJK_SHAPES = {"力口工夕卜八二一へべぺ": "カロエタトハニーヘベペ", "〜∼": "~~"}
#: Signs for Roman numerals and ligatures, each with the letters it looks like.
SEVERAL = {
    "Ⅷ": "VIII", "Ⅶ": "VII", "Ⅲ": "III", "Ⅻ": "XII", "Ⅱ": "II", "Ⅳ": "IV", "Ⅵ": "VI", "Ⅸ": "IX", "Ⅺ": "XI",
    "ⅷ": "viii", "ⅶ": "vii", "ⅲ": "iii", "ⅻ": "xii", "ⅱ": "ii", "ⅳ": "iv", "ⅵ": "vi", "ⅸ": "ix", "ⅺ": "xi",
    "ﬃ": "ffi", "ﬄ": "ffl", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "…": "...", "‥": "..",
}


def _pairs() -> tuple[str, str]:
    """Characters to replace and their replacements, from the compatibility forms of one character and the fixed values."""
    table: dict[str, str] = {}
    for lo, hi in ((0xFF01, 0xFFEF), (0x2E80, 0x2FE0), (0x2160, 0x2180), (0x1D400, 0x1D800)):
        for c in map(chr, range(lo, hi)):
            form = unicodedata.normalize("NFKC", c)
            if len(form) == 1 and form != c and not form.isspace():
                table[c] = form
    table["ﾞ"], table["ﾟ"] = "゙", "゚"  # half-width marks join the kana before them
    table["⻨"] = table.get("⻨", "麦")
    for many in (LATIN_SHAPES, CJK_SHAPES):
        for a, b in many.items():
            table |= dict(zip(a, b))
    for c in list(table):  # shapes also hold behind width forms and radicals
        table[c] = table.get(table[c], table[c])
    return "".join(table), "".join(table.values())


FROM, TO = _pairs()
INVISIBLE = "[\\p{Cf}\\x{034F}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]"
BLANK = "[\\t\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\x{3164}\\x{FFA0}\\x{2800}]"


def skeleton(value: Column) -> Column:
    """The look of a value, up to what the collation ``UNICODE`` joins; null stays null."""
    s = F.when(value.rlike(f"{INVISIBLE}|{BLANK}"), F.regexp_replace(F.regexp_replace(value, INVISIBLE, ""), BLANK, " ")).otherwise(value)
    many = s
    for sign, letters in SEVERAL.items():
        many = F.replace(many, F.lit(sign), F.lit(letters))
    s = F.when(s.rlike("[" + "".join(SEVERAL) + "]"), many).otherwise(s)
    return F.translate(s, FROM, TO)


def _bases(lo: int, hi: int) -> tuple[str, str]:
    """Characters of a range with a canonical decomposition, and the first character of each."""
    forms = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(lo, hi))}
    return "".join(c for c, f in forms.items() if f != c), "".join(f for c, f in forms.items() if f != c)


SMALL_FROM, SMALL_TO = _bases(0xC0, 0x3400)
FULL_FROM, FULL_TO = (a + b + c + d for a, b, c, d in zip((SMALL_FROM, SMALL_TO), _bases(0xAC00, 0xD7A4), _bases(0xF900, 0xFB50), _bases(0x2F800, 0x2FA20)))


def base(look: Column) -> Column:
    """A skeleton without marks, vowels and ends of Hangul syllables, and controls: equal where the collation finds skeletons equal.

    The table with all Hangul syllables is asked for only where there are such: at every row the engine compares
    a table with the one before it.
    """
    full = look.rlike("[\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FB4F}\\x{2F800}-\\x{2FA1F}]")
    plain = F.when(full, F.translate(look, FULL_FROM, FULL_TO)).otherwise(F.translate(look, SMALL_FROM, SMALL_TO))
    return F.regexp_replace(plain, "[\\p{M}\\p{Cc}\\x{1160}-\\x{11FF}]", "")


#: Values of such characters alone are their own base.
PLAIN = "^[\\x20-\\x7E\\x{3001}-\\x{301F}\\x{30FB}\\x{30FC}\\x{4E00}-\\x{9FFF}\\x{FF00}-\\x{FF0F}]*$"


def doubtful(rows: DataFrame, field: str, value: str) -> DataFrame:
    """``rows`` with ``look``, those alone whose value shares its base with another value of its field.

    Values of a group are counted by the least and greatest of two hashes of 96 bits together, so that the
    groups are combined before the shuffle.
    """
    x = rows.where(F.col(value).isNotNull()).withColumn("look", skeleton(F.col(value)))
    own = F.when(F.col("look").rlike(PLAIN), F.col("look")).otherwise(base(F.col("look")))
    x = x.withColumn("base", F.coalesce(own, F.lit("")))  # never null, so that the planner does not compute it once more to filter nulls
    hashes = {"h": F.xxhash64(value), "g": F.hash(value)}
    ends = [f(c).alias(f"{n}{i}") for n, c in hashes.items() for i, f in enumerate((F.min, F.max))]
    several = x.groupBy(field, "base").agg(*ends).where("h0 != h1 or g0 != g1").select(field, "base")
    return x.join(several, [field, "base"], "left_semi").drop("base")


def _classes(values: DataFrame, field: str, value: str) -> DataFrame:
    """(field, value, canonical, n_values) of the distinct (field, value, look)."""
    looks = values.select(field, value, F.collate("look", "UNICODE").alias("look"))
    plain = F.collate("look", "UTF8_BINARY")
    rank = F.struct((F.col(value) != plain).alias("changed"), F.length(value).alias("size"), F.col(value).alias("member"))
    heads = looks.groupBy(field, "look").agg(F.min(rank)["member"].alias("canonical"), F.count("*").alias("n_values"))
    return looks.join(heads, [field, "look"]).select(field, value, "canonical", "n_values")


def classes(values: DataFrame, field: str, value: str) -> DataFrame:
    """(field, value, canonical, n_values): every value that is not alone in its class, with the canonical member.

    The canonical member is the one with the least changes to its skeleton, then the shortest, then the
    first in binary order. Values of different fields never meet. Nulls are left out; empty values and
    values that are invisible form a class of their own. A value that does not come out is its own class.
    """
    some = stored(doubtful(values.select(field, value), field, value).distinct(), "lookalike")
    return _classes(some, field, value).where("n_values > 1")


def canonical_values(rows: DataFrame, field: str, key: str, value: str) -> DataFrame:
    """``rows`` (field, key, value) with ``canonical`` joined back; rows with a null value keep a null."""
    names = classes(rows, field, value).select(field, value, "canonical")
    return rows.select(field, key, value).join(names, [field, value], "left").withColumn("canonical", F.coalesce("canonical", value))


def lookalike_pairs(rows: DataFrame, field: str, key: str, value: str) -> DataFrame:
    """(field, key_a, key_b), key_a < key_b: rows of one field whose values differ in code points but look the same.

    Rows are told apart by key; repeated rows count once. The join is between the spellings of a class, so a
    stock name in one spelling makes no pair at all, and the adaptive skew join splits a class that holds many
    rows. All pairs of rows come out, as the table of cases asks; ``canonical_values`` is the form that grows with the
    rows alone.
    """
    some = stored(doubtful(rows.select(field, key, value).where(F.col(key).isNotNull()), field, value).distinct(), "lookalike")
    names = _classes(some.select(field, value, "look").distinct(), field, value).where("n_values > 1").drop("n_values")
    members = some.select(field, key, value).join(names, [field, value])
    a = members.select(field, "canonical", F.col(key).alias("key_a"), F.col(value).alias("value_a"))
    b = members.select(field, "canonical", F.col(key).alias("key_b"), F.col(value).alias("value_b"))
    return a.join(b, [field, "canonical"]).where("key_a < key_b and value_a != value_b").select(field, "key_a", "key_b").distinct()
