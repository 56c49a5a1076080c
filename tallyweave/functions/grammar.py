"""Locale-specific text grammar: case folding, numbers, labels, roles.

Everything here is a column expression; nothing leaves whole-stage code generation.  Patterns, marks and
role phrases are fixed values of the document class and are kept together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the document class.
BLANKS = " \t\n\x0b\x0c\r"
DASHES = ("-", "–", "—", "~")
INT = r"^[0-9]{1,3}(\.[0-9]{3})+$|^[0-9]{1,3}$"
DECIMAL = r"^[0-9]{1,3}(\.[0-9]{3})*,[0-9]+$"
PERCENT = r"^%([0-9]+(,[0-9]+)?)$"
PERCENT_RANGE = r"^%([0-9]+(,[0-9]+)?)-%([0-9]+(,[0-9]+)?)$"
LOST_GROUP = r"^[0-9]+(\.[0-9]{3})+$"
BARE_DIGITS = r"^[0-9]{4,}$"
#: INT, LOST_GROUP or BARE_DIGITS.
WHOLE = r"^[0-9]+(\.[0-9]{3})*$"
NUMERIC_TOKEN = r"^\(?[%0-9][0-9.,%()\-]*\)?$"
UNIT_JUNK = r"\s*\([%©®°0-9o]{1,2}\)\s*$"
LOOKALIKES, LOOKALIKE_DIGITS = "lIİiOoSB", "11110058"
ROLE_PHRASES = (("açılış bakiyesi", "opening"), ("kapanış bakiyesi", "closing"), ("net defter değeri", "closing_equiv"))
TOTAL_WORD = "toplam"
RATE_WORD = "oran"
SLUG_REST = "[^a-z0-9çğıöşü]+"
#: Letters whose decomposed forms are composed before folding (there is no normalisation function here).
COMPOSED = (("İ", "İ"), ("ğ", "ğ"), ("Ğ", "Ğ"), ("ş", "ş"), ("Ş", "Ş"), ("ç", "ç"), ("Ç", "Ç"), ("ö", "ö"), ("Ö", "Ö"), ("ü", "ü"), ("Ü", "Ü"))
YEARS = (1900, 2100)

NUMBER_TYPE = "struct<state:string,kind:string,value:decimal(38,6),value_high:decimal(38,6),repaired:boolean,parse_conf:double>"


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def fold(s: Column) -> Column:
    """Lower case with dotted and dotless i kept apart; composed letters in, composed letters out."""
    for parts, letter in COMPOSED:
        s = F.replace(s, F.lit(parts), F.lit(letter))
    return F.replace(F.lower(F.translate(s, "İI", "iı")), F.lit("̇"), F.lit(""))


def _decimal(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(38,6)")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_number(token: Column) -> Column:
    """A token as NUMBER_TYPE, or null when it is not numeric.

    Empty, dash and number are three states.  Parentheses negate; a group that lost a dot is repaired at
    0.7, more than three bare digits at 0.5; a leading minus is not numeric.
    """

    def parts(t: Column) -> Column:
        negative = t.startswith("(") & t.endswith(")")
        core = F.when(negative, strip(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)
        return let(F.struct(t.alias("t"), core.alias("core"), negative.alias("negative")), shape)

    def shape(p: Column) -> Column:
        c = p["core"]
        kind = (
            F.when(p["t"] == "", "empty")
            .when(p["t"].isin(*DASHES), "dash")
            .when(c.rlike(PERCENT_RANGE), "percent_range")
            .when(c.rlike(PERCENT), "percent")
            .when(c.rlike(DECIMAL), "decimal")
            .when(c.rlike(INT), "int")
            .when(c.rlike(LOST_GROUP), "lost_group")
            .when(c.rlike(BARE_DIGITS), "bare")
        )
        return let(F.struct(c.alias("core"), p["negative"].alias("negative"), kind.alias("kind")), number)

    def number(p: Column) -> Column:
        k, c = p["kind"], p["core"]
        absent, fixed = k.isin("empty", "dash"), k.isin("lost_group", "bare")
        plain = _decimal(F.when(k == "percent", F.regexp_extract(c, PERCENT, 1)).when(k == "percent_range", F.regexp_extract(c, PERCENT_RANGE, 1)).otherwise(c))
        value = F.when(p["negative"] & (k != "percent_range"), -plain).otherwise(plain).cast("decimal(38,6)")
        made = F.struct(
            F.when(absent, k).otherwise("number").alias("state"),
            F.when(absent, None).when(fixed, "int").otherwise(k).alias("kind"),
            F.when(~absent, value).alias("value"),
            F.when(k == "percent_range", _decimal(F.regexp_extract(c, PERCENT_RANGE, 3))).alias("value_high"),
            fixed.alias("repaired"),
            F.when(k == "lost_group", 0.7).when(k == "bare", 0.5).otherwise(1.0).alias("parse_conf"),
        )
        return F.when(k.isNotNull(), made)

    return let(strip(token), parts)


def is_numeric_token(token: Column) -> Column:
    return strip(token).rlike(NUMERIC_TOKEN)


def is_money(token: Column) -> Column:
    """A dash, or a number that looks like an amount; bare years are headers, not amounts."""
    t = strip(token)
    core = F.when(t.startswith("(") & t.endswith(")"), strip(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    marked = core.rlike("|".join((PERCENT_RANGE, PERCENT, DECIMAL)))
    digits = F.ltrim(F.replace(core, F.lit("."), F.lit("")), F.lit("0"))
    dotted = F.contains(t, F.lit("."))
    year = ~dotted & ~t.startswith("(") & (F.length(digits) == 4) & digits.between(*map(str, YEARS))
    whole = core.rlike(WHOLE) & ~year & (dotted | F.contains(t, F.lit("(")) | (F.length(digits) >= 4) | (t == "0"))
    return F.coalesce(t.isin(*DASHES) | (t.rlike(NUMERIC_TOKEN) & (marked | whole)), F.lit(False))


def is_small_ref(token: Column) -> Column:
    return strip(token).rlike("^[0-9]{1,2}$")


def clean_label(label: Column) -> Column:
    return F.btrim(F.regexp_replace(label, r"\(\*+\)", ""), F.lit(" .:"))


def label_marks(label: Column) -> Column:
    return F.regexp_extract_all(label, F.lit(r"\((\*+)\)"), 1)


def norm_label(label: Column) -> Column:
    s = strip(F.ltrim(fold(clean_label(label)), F.lit("-")))
    return F.regexp_replace(strip(F.regexp_replace(s, UNIT_JUNK, "")), r"\s+", " ")


def row_role(label: Column) -> Column:

    def told(s: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for phrase, role in ROLE_PHRASES:
            out = out.when(F.contains(s, F.lit(phrase)), role)
        return out.when((strip(s) == TOTAL_WORD) | s.startswith(TOTAL_WORD + " "), "total").otherwise("flow")

    return let(fold(label), told)


def slug(s: Column) -> Column:
    made = F.btrim(F.regexp_replace(fold(s), SLUG_REST, "_"), F.lit("_"))
    return F.when(made == "", "col").otherwise(made)


def note_number(token: Column) -> Column:
    digits = F.translate(F.rtrim(strip(token), F.lit(".,")), LOOKALIKES, LOOKALIKE_DIGITS)
    n = F.when(digits.rlike("^[0-9]+$"), digits.try_cast("int"))
    return F.when(n.between(1, 99), n)


def is_rate_label(label: Column) -> Column:
    return F.contains(fold(label), F.lit(RATE_WORD))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def digit_vote(primary: Column, other: Column) -> Column:
    """exact, suffix (one reading ends in the other) or mismatch; an empty reading never votes for."""
    empty = (primary == "") | (other == "")
    return F.when(empty, "mismatch").when(primary == other, "exact").when(primary.endswith(other) | other.endswith(primary), "suffix").otherwise("mismatch")


def amount_text(value: Column) -> Column:
    """Grouped by dots, decimal comma, parentheses when negative.  ``value`` is a decimal with two places."""
    whole = F.translate(F.format_number(F.floor(F.abs(value)), 0), ",", ".")
    cents = F.lpad((F.abs(value) * 100 % 100).cast("int").cast("string"), 2, "0")
    text = F.when(cents == "00", whole).otherwise(F.concat(whole, F.lit(","), cents))
    return F.when(value < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def pair_text(label: Column, amounts: Column) -> Column:
    """``label | a ; b``; the bare label without amounts."""
    return F.when(F.size(amounts) > 0, F.concat(label, F.lit(" | "), F.array_join(amounts, " ; "))).otherwise(label)


def letters(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"\p{L}"))


def upper_share(s: Column) -> Column:
    """Upper-case letters among letters; null without letters."""
    n = letters(s)
    return F.when(n > 0, F.regexp_count(s, F.lit(r"\p{Lu}")) / n)


#: Deny patterns of the hygiene scan: (kind, pattern).
DENY = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("phone", r"\+[0-9][0-9 ()-]{8,}[0-9]"),
    ("home_path", r"/(?:home|Users)/[a-z][a-z0-9_-]+"),
)


def deny_matches(line: Column) -> Column:
    """``array<struct<kind, match>>`` of everything a line should not carry."""


    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(line, F.lit(pattern), 0), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("match")))

    return F.concat(*[of(*d) for d in DENY])
