"""Personal data replaced by keyed surrogates that keep type, format, script and gender.

Entities are found by one regular expression: e-mail addresses in letters of any script, phone numbers
(international, and as written in English, German, French and Spanish), payment cards of 14 to 19 digits,
bank accounts (IBAN), national ids, IPv4 and IPv6 addresses, access keys, passwords and tokens after their
name (in any case; to the closing quote, or else to the next space but for closing quotes, brackets and .,;
at the end), and personal names after titles, one or several ("Herr Prof. Dr. med."), which tell their gender. Words such as "pass is" name a secret
only if what follows has a digit. Every part of a name that a text
gives with a title counts in the same text wherever it stands as a capitalised word of its own, so
"Anna Schmidt", "Schmidt" and "Anna" after "Dr Anna Schmidt" are found too; words that only other
texts give as names are not.

An entity's canonical form (lower case; digits only for numbers) and type name it across the whole table,
so that all mentions of it get one surrogate, written in each mention's own layout and case. A name is
mapped part by part, so that a full name and its parts, with whatever title, agree; initials stay. A part is
female or male if all titles before it in the table that tell a gender agree on it. A surrogate is made of the digest of
key, type, canonical form and attempt: digits become digits, letters letters of their script (Latin ones
where it is none of the known), other marks of a secret other marks, a part of a name a pronounceable one of the same
script and gender, a card that passes the Luhn check one of the same first digit that passes it, a social security number one of issued groups,
a private address one of the same range, an IBAN with right check digits
one of the same country with right check digits.

Two entities of one type with equal surrogates, or a surrogate that is itself an entity of the table,
are collisions: all but the first entity try again with the next attempt until there are none. What
still collides after ``ATTEMPTS`` takes longer surrogates, by one more character (a syllable in a part
of a name, a digit in each octet) with each further attempt, so that there are always enough of them.

A null text stays null and holds nothing; texts without entities are unchanged; repeated rows get equal
results; an empty table gives an empty result; other columns are ignored. ``n_entities`` counts mentions, each
word of a name without a title by itself.
"""

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

ATTEMPTS = 40

# Titles by the gender they tell.
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа|госпожа|κυρία"
MALE = "Mr|Herr|Monsieur|Señor|Sr|г-н|господин|κύριος"
NEUTRAL = "Dr|Dra|Prof|Professor|Doctor|Doktor|Dipl|Ing|Mag|Rev"
# degrees that follow such a title
_DEGREE = "med|phil|jur|rer|nat|pol|oec|dent|vet|ing|mult"
_STACK = rf"(?:(?:{FEMALE}|{MALE}|{NEUTRAL})\.?[ -](?:(?:{_DEGREE})\.? ?(?=[\p{{L}}])){{0,3}}){{1,4}}"
_EDGE, _END = r"(?<![\p{L}\p{N}_.+-])", r"(?![\p{L}\p{N}_-])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# names of secrets with the signs that follow; what follows these is the secret
_GAP = r"[\s\p{Z}]"
_LABEL = (
    rf"(?:(?i:password|passwd|token|secret|api[_-]?key)[\"'\\]{{0,2}}+{_GAP}*+(?::=|=>|[=:]){_GAP}*+"
    # these are common words too, so that the secret must have a digit
    rf"|(?i:password|passwd|pwd|pass|token|secret)[\"'\\]{{0,2}}+(?:{_GAP}*+(?::=|=>|[=:])|{_GAP}++(?i:is|was|ist|es|est):?+{_GAP}){_GAP}*+(?=[^\s\p{{Z}}]{{0,64}}\d))\\?+[\"']?+"
)
_IN, _LAST = r"[^\s\p{Z}]", r"[^\s\p{Z}\"',;.)\]}>]"
_SECRET = "|".join((
    r"(?<=\")[^\"\r\n]{8,}+(?<!\\)(?=\")", r"(?<=')[^'\r\n]{8,}+(?<!\\)(?=')",  # to the closing quote
    rf"(?<=[\"'])(?=[^\s\p{{Z}}\"']{{8}}){_IN}{{7,}}{_LAST}", rf"(?<![\"']){_IN}{{7,}}{_LAST}",
))
# signs of a secret that keep their place: those of base64, hex, JWT and URLs; others become other marks
_KEPT, _MARKS = r"[-._/+=~:\s\p{Z}]", "!#$%*?@^"
# phone numbers: North America; with a country code; German and British; French; Spanish
_PHONES = "|".join((
    r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}",
    r"(?:\+|00)[1-9](?:[ ./()-]{0,3}\d){7,14}",
    r"(?!\d{3}-\d{2}-\d{4}(?!\d))(?:\(0[1-9]\d{1,3}\)|0[1-9]\d{1,3})[ /-]{1,3}\d{3,8}(?:[ -]\d{2,5}){0,3}",
    r"0[1-9](?:\d{8}|(?: \d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4})",
    r"(?<!\d )[6-9]\d{2}(?: \d{3} \d{3}(?! \d{3}(?!\d))|-\d{3}-\d{3}|(?: \d{2}){3}|(?:-\d{2}){3})",
))
# what stays of a phone number: country codes and the zero of national numbers
_CODE = r"^(?:(?:\+|00)(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})|0)"
_LOCAL, _HOST = r"[\p{L}\p{M}\p{N}._%+-]", r"[\p{L}\p{M}\p{N}-]"
# one name part after another, the first of them maybe initials; words of a name are runs of letters
_WORD, _PART = r"[\p{L}\p{M}]+", r"\p{Lu}[\p{L}\p{M}'’-]*[\p{L}\p{M}]"
_SIX = r"[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@{_HOST}+(?:\.{_HOST}{{1,63}}){{0,126}}\.\p{{L}}(?:{_HOST}*[\p{{L}}\p{{N}}])",
    "iban": r"(?=[A-Z]{2}\d\d)" + _EDGE + r"[A-Z]{2}\d\d(?: ?(?=[0-9A-Z]{0,3}\d)[0-9A-Z]{4}){2,7}(?: ?\d[0-9A-Z]{0,2})?" + _END,
    "phone": r"(?=[+(\d])" + _EDGE.replace("+", "") + f"(?:{_PHONES})" + _END,
    "card": r"(?=\d)" + _EDGE + r"(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?:[ -]?\d{3})?|3[47]\d\d[ -]?\d{6}[ -]?\d{5}|3[068]\d\d[ -]?\d{6}[ -]?\d{4})" + _END,
    "ssn": r"(?=\d)" + _EDGE + r"\d{3}-\d{2}-\d{4}" + _END,
    "ip": r"(?=\d)" + _EDGE + _OCTET + r"(?:\." + _OCTET + r"){3}(?![\p{L}\p{N}_-]|\.\d)",
    "ip6": rf"(?=[0-9A-Fa-f:]{{0,38}}\d)(?<![\p{{L}}\p{{N}}:.])(?:(?:{_SIX}:){{7}}{_SIX}|(?:{_SIX}:){{1,6}}(?::{_SIX}){{1,6}}|(?:{_SIX}:){{2,7}}:|:(?::{_SIX}){{2,7}})(?![\p{{L}}\p{{N}}:])",
    "key": r"(?=A)(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": rf"(?=[PpTtSsAa]){_LABEL}(?=(?:(?<=[\"'])[-._/+=~: ]*+|[-._/+=~:]*+)[^-._/+=~:\s\p{{Z}}\"'])(?:{_SECRET})",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_STACK}(?:\p{{Lu}}\.? ){{0,2}}{_PART}(?: {_PART}){{0,2}}",
}
_INSIDE = ("key", "secret")  # these may follow a letter or digit; all others start a word, which one look behind tells
ANY = "(?<![\\p{L}\\p{N}])(?:" + "|".join(p for k, p in PATTERNS.items() if k not in _INSIDE) + ")|" + "|".join(f"(?:{PATTERNS[k]})" for k in _INSIDE)
#: A capitalised word: in a text that names somebody it may be a part of the name.
LONE = r"(?<![\p{L}\p{M}\p{N}_])\p{Lu}[\p{L}\p{M}]+"
WITH_LONE = f"{ANY}|{LONE}"
_TITLE = rf"^{_STACK}"
_PREFIX = rf"^{_LABEL}|{_TITLE}"
# The letters that surrogate names are made of, by script: consonants, vowels, endings of
# female, male and other names.
SCRIPTS = {
    "latin": ("bdfgklmnprstvz", "aeiou", ("a", "on", "e")),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", ("а", "ан", "о")),
    "greek": ("βγδζκλμνπρστ", "αεηιο", ("α", "ος", "ο")),
}


def kind_of(mention: Column) -> Column:
    """The type of a whole mention without the name of a secret; ``lone`` for a capitalised word."""
    out = None
    for kind, pattern in PATTERNS.items():
        if kind == "secret":  # what is nothing else
            continue
        hit = mention.rlike(f"^(?:{pattern})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.when(mention.rlike(f"^(?:{LONE})$"), "lone").otherwise("secret")


def _titled(titles: str) -> Column:
    """Whether one of some titles is among those before a name."""
    return F.regexp_extract("mention", _TITLE, 0).rlike(rf"(?<![\p{{L}}])(?:{titles})[. -]")


def _described(mentions: DataFrame) -> DataFrame:
    """Mentions with type, gender, and the canonical form that names the entity (for names: that of all parts)."""
    m = F.col("mention")
    label = m.rlike(f"^{_LABEL}")
    kind = kind_of(F.regexp_replace(m, f"^{_LABEL}", ""))
    out = mentions.withColumn("kind", F.when(label & kind.isin("lone", "name"), "secret").otherwise(kind)).withColumn("bare", F.regexp_replace(m, _PREFIX, ""))
    gender = F.when(F.col("kind") != "name", "").when(_titled(FEMALE), "f").when(_titled(MALE), "m").otherwise("")
    low, compact = F.lower("bare"), F.regexp_replace("bare", "[ -]", "")
    digits = F.regexp_replace("bare", r"\D", "")
    digits = F.when(F.col("bare").startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    canonical = F.when(F.col("kind").isin("phone", "card", "ssn"), digits).when(F.col("kind") == "iban", compact).when(F.col("kind").isin("email", "name", "lone", "ip6"), low).otherwise(F.col("bare"))
    return out.withColumn("gender", gender).withColumn("canonical", canonical)


def _parts(found: DataFrame) -> DataFrame:
    """``row_key, place, pos, kind, gender, script, word, canonical`` of the words of names and lone words."""
    some = found.where("kind in ('name', 'lone')").select("row_key", "place", "kind", "gender", F.posexplode(F.regexp_extract_all("bare", F.lit(_WORD), F.lit(0))).alias("pos", "word"))
    script = F.when(F.col("word").rlike(r"\p{IsCyrillic}"), "cyrillic").when(F.col("word").rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    return some.withColumn("script", script).withColumn("canonical", F.lower("word"))


def _entities(found: DataFrame, parts: DataFrame) -> DataFrame:
    """``kind, gender, script, canonical`` of distinct entities."""
    plain = found.where("kind not in ('name', 'lone')").select("kind", F.lit("").alias("gender"), F.lit("").alias("script"), "canonical").distinct()
    told = lambda g: F.max((F.col("gender") == g).cast("int"))
    named = parts.where("kind = 'name' and length(word) > 1").groupBy("script", "canonical").agg(told("f").alias("f"), told("m").alias("m"))
    gender = F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise("n")
    return plain.unionByName(named.select(F.lit("name").alias("kind"), gender.alias("gender"), "script", "canonical"))


def _byte(digest: Column, i: Column) -> Column:
    """The i-th byte (from 0, around) of a hex digest as a number."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _same_shape(text: Column, digest: Column, lower: str = "abcdefghijklmnopqrstuvwxyz", marks: bool = False) -> Column:
    """Digits for digits (a leading one is not zero), letters for letters, and with ``marks`` signs for signs; the rest stays."""

    def one(c, i):
        b = _byte(digest, i)
        digit = F.when((i == 0) & (c != "0"), (F.pmod(b, F.lit(9)) + 1).cast("string")).otherwise(F.pmod(b, F.lit(10)).cast("string"))
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        out = F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), _letter(lower, b)).when(c.rlike("[A-Z]"), _letter(upper, b))
        for name in ("cyrillic", "greek"):
            small, own = "".join(SCRIPTS[name][:2]), c.rlike(rf"\p{{Is{name.title()}}}")
            out = out.when(own & c.rlike(r"\p{Lu}"), _letter(small.upper(), b)).when(own, _letter(small, b))
        out = out.when(c.rlike(r"\p{Lu}"), _letter(upper, b)).when(c.rlike(r"[\p{L}\p{M}]"), _letter(lower, b)).when(c.rlike(r"\p{N}"), digit)
        return (out.when(~c.rlike(_KEPT), _letter(_MARKS, b)) if marks else out).otherwise(c)

    return F.array_join(F.transform(_chars(text), one), "")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    n = F.length(digits)
    each = F.transform(_chars(digits), lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10))


def _name_part(hard: str, soft: str, ends: tuple[str, str, str], digest: Column, wide: Column) -> Column:
    """A part of a name: two or three syllables and ``wide`` more, and an ending that tells the gender."""
    end = F.when(F.col("gender") == "f", ends[0]).when(F.col("gender") == "m", ends[1]).otherwise(ends[2])
    size = F.when(F.length("canonical") > 6, 3).otherwise(2) + wide
    syllable = lambda k: F.concat(_letter(hard, _byte(digest, k * 2)), _letter(soft, _byte(digest, k * 2 + 1)))
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), size), syllable), ""), _letter(hard, _byte(digest, F.lit(0))), end)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of digits and capital letters (A: 10, ..., Z: 35) read as one number."""
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: F.pmod(F.when(value(c) > 9, a * 100).otherwise(a * 10) + value(c), F.lit(97)))


def _iban(canonical: Column, digest: Column, more: Column) -> Column:
    """Country and check digits over other digits and letters; right check digits stay right."""
    body = _same_shape(F.concat(F.expr("substring(canonical, 5)"), more), digest)
    country = F.substring(canonical, 1, 2)
    right = _mod97(F.concat(F.expr("substring(canonical, 5)"), F.substring(canonical, 1, 4))) == 1
    check = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, F.when(right, check).otherwise(F.substring(canonical, 3, 2)), body)


def _surrogate(key: str, attempts: int = ATTEMPTS) -> Column:
    """The surrogate's canonical form at the entity's current attempt; beyond ``attempts`` it grows."""
    d = F.sha2(F.concat_ws("\0", F.lit(key), "kind", "script", "canonical", F.col("attempt").cast("string"), F.lit(key)), 512)
    wide = F.greatest(F.col("attempt") - attempts, F.lit(0))
    c, kind = F.col("canonical"), F.col("kind")
    more = lambda letter: F.repeat(F.lit(letter), wide)
    local, domain = F.concat(F.substring_index(c, "@", 1), more("a")), F.substring_index(c, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.expr("left(substring_index(canonical, '@', -1), length(substring_index(canonical, '@', -1)) - length(substring_index(substring_index(canonical, '@', -1), '.', -1)) - 1)")
    email = F.concat(_same_shape(local, d), F.lit("@"), _same_shape(host, F.sha2(F.concat(F.lit(key), host), 512)), F.lit("."), top)
    grown = F.concat(c, F.when(kind.isin("card", "ssn"), more("0")).otherwise(more("a")))
    shape = F.when(c.rlike("^[0-9a-f]{16,}$"), _same_shape(grown, d, "abcdef")).otherwise(_same_shape(grown, d, marks=True))
    body = F.concat(F.expr("left(canonical, length(canonical) - 1)"), more("0"))
    card = F.concat(F.substring(body, 1, 1), F.substring(_same_shape(body, d), 2, 99))  # the digit of the issuer stays
    check = F.pmod(F.lit(10) - luhn(F.concat(card, F.lit("0"))), F.lit(10)).cast("string")
    card = F.when(luhn(c) == 0, F.concat(card, check)).otherwise(shape)
    code = F.regexp_extract(c, _CODE, 0)
    phone = F.concat(code, _same_shape(F.concat(F.regexp_replace(c, _CODE, ""), more("0")), d))
    # octets of as many digits, of more digits, of any value; when even all addresses are taken, more octets
    size = lambda o: F.least(F.length(o) + wide, F.lit(4))
    octet = lambda o, i: F.when(size(o) == 4, _byte(d, i)).when(size(o) == 3, 100 + F.pmod(_byte(d, i), F.lit(100))).when(size(o) == 2, 10 + F.pmod(_byte(d, i), F.lit(90))).otherwise(1 + F.pmod(_byte(d, i), F.lit(9))).cast("string")
    octets = F.concat(F.split(c, r"\."), F.array_repeat(F.lit("000"), F.greatest(wide - 16, F.lit(0))))
    # a private address stays in its range, and no other one gets into it
    kept = F.when(c.rlike(r"^(?:10|127)\."), 1).when(c.rlike(r"^(?:192\.168|172\.(?:1[6-9]|2\d|3[01]))\."), 2).otherwise(0)
    b0 = _byte(d, F.lit(0))
    head = lambda o: F.when(size(o) == 4, 128 + F.pmod(b0, F.lit(40))).when(size(o) == 3, 101 + F.pmod(b0, F.lit(26))).when(size(o) == 2, 11 + F.pmod(b0, F.lit(89))).otherwise(1 + F.pmod(b0, F.lit(9))).cast("string")
    ip = F.array_join(F.transform(octets, lambda o, i: F.when(i < kept, o).when(i == 0, head(o)).otherwise(octet(o, i))), ".")
    # area, group and serial that are issued
    number = lambda k, most: 1 + F.pmod(F.conv(F.substring(d, k, 7), 16, 10).cast("long"), F.lit(most))
    ssn = F.concat(F.lpad(number(1, 665).cast("string"), 3, "0"), F.lpad(number(9, 99).cast("string"), 2, "0"), F.lpad(number(17, 9999).cast("string"), 4, "0"), F.substring(_same_shape(more("0"), d), 1, 99))
    access = F.concat(F.lit("AKIA"), _same_shape(F.concat(F.expr("substring(canonical, 5)"), F.upper(more("a"))), d))
    name = None
    for script, (hard, soft, ends) in SCRIPTS.items():
        made = _name_part(hard, soft, ends, d, wide)
        name = F.when(F.col("script") == script, made) if name is None else name.when(F.col("script") == script, made)
    ip6 = _same_shape(F.concat(c, F.repeat(F.lit("0"), wide)), d, "abcdef")
    iban = _iban(c, d, more("0"))
    return F.when(kind == "email", email).when(kind == "iban", iban).when(kind == "ip6", ip6).when(kind == "card", card).when((kind == "ssn") & (F.length(c) == 9), ssn).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "key", access).when(kind == "name", name).otherwise(shape)


def surrogates(entities: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """``kind, gender, script, canonical, surrogate`` of distinct entities, without collisions."""
    names, made = ["kind", "gender", "script", "canonical"], _surrogate(key, attempts)
    now = stored(entities.select(*names).distinct().withColumn("attempt", F.lit(0)).withColumn("surrogate", made), "surrogates-0")
    for attempt in itertools.count(1):  # ends: beyond ``attempts`` each round has several times the surrogates
        # the first entity of a surrogate keeps it, unless it names an entity of the table
        first = now.groupBy("kind", "surrogate").agg(F.min(F.struct("canonical", "gender", "script")).alias("first"))
        real = now.select("kind", F.col("canonical").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        seen = now.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        bad = F.col("real").isNotNull() | (F.col("first") != F.struct("canonical", "gender", "script"))
        marked = seen.select(*names, "attempt", "surrogate", bad.alias("bad"))
        if not marked.where("bad").limit(1).count():
            return now.drop("attempt")
        again = marked.withColumn("attempt", F.col("attempt") + F.col("bad").cast("int"))
        now = stored(again.withColumn("surrogate", F.when(F.col("bad"), made).otherwise(F.col("surrogate"))).drop("bad"), f"surrogates-{attempt}")


def _written() -> Column:
    """A surrogate in the layout and case of the mention (no name) that it stands for."""
    s, bare = F.col("surrogate"), F.col("bare")
    # the k-th digit (of an IBAN: digit or letter) of the mention becomes the k-th of the surrogate
    iban = F.col("kind") == "iban"
    sign, other = F.when(iban, "[0-9A-Z]").otherwise("[0-9]"), F.when(iban, "[^0-9A-Z]").otherwise("[^0-9]")
    number, size = F.regexp_replace(s, other, F.lit("")), lambda x: F.length(F.regexp_replace(x, other, F.lit("")))
    spread = F.array_join(F.transform(_chars(bare), lambda c, i: F.when(F.regexp_like(c, sign), F.substring(number, size(F.substring(bare, F.lit(1), i + 1)), F.lit(1))).otherwise(c)), "")
    # a longer surrogate goes on after the mention's last digit
    spread = F.concat(spread, F.substring(number, size(bare) + 1, F.length(number)))
    cased = F.when((bare == F.upper(bare)) & (bare != F.lower(bare)), F.upper(s)).otherwise(s)
    written = F.when(F.col("kind").isin("phone", "card", "ssn", "iban"), spread).when(F.col("kind").isin("email", "ip6"), cased).otherwise(s)
    return F.concat(F.regexp_extract("mention", _PREFIX, 0), written)


def _rewritten(found: DataFrame, parts: DataFrame, of: DataFrame) -> DataFrame:
    """``row_key, place, new`` of the mentions of names: each part replaced, all between them as it was."""
    # lone words count where the text itself gives them as part of a name
    given = parts.where("kind = 'name' and length(word) > 1").select("row_key", "canonical").distinct().withColumn("given", F.lit(True))
    known = parts.join(given, ["row_key", "canonical"], "left").join(of.where("kind = 'name'").select("script", "canonical", "surrogate"), ["script", "canonical"], "left")
    changed = F.col("given") & F.col("surrogate").isNotNull() & (F.length("word") > 1)
    cased = F.when(F.col("word") == F.upper("word"), F.upper("surrogate")).otherwise(F.initcap("surrogate"))
    # a mention's words are bounded by its own length
    lists = known.groupBy("row_key", "place").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(changed, cased).otherwise(F.col("word")).alias("word")))).alias("words"), F.max(F.coalesce(changed, F.lit(False))).alias("changed"))
    both = found.where("kind in ('name', 'lone')").join(lists, ["row_key", "place"])
    made = F.array_join(F.zip_with(F.split("bare", _WORD, -1), "words", lambda between, w: F.concat(F.coalesce(between, F.lit("")), F.coalesce(w["word"], F.lit("")))), "")
    return both.select("row_key", "place", F.concat(F.regexp_extract("mention", _PREFIX, 0), made).alias("new"), "changed")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of their id and text, equal for repeated rows only."""
    return docs.select("doc_id", "text", F.struct("doc_id", F.xxhash64("text").alias("text")).alias("row_key"))


def mentions(docs: DataFrame) -> DataFrame:
    """``row_key, named, place, mention`` with type, gender and canonical form of every mention.

    ``named`` texts give a name with a title; their capitalised words are mentions of kind ``lone``.
    """
    extracted = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    found = _keyed(docs).select("row_key", "text", extracted(ANY).alias("found")).where(F.size("found") > 0)
    found = found.withColumn("named", F.exists("found", lambda x: x.rlike(_TITLE)))
    found = found.select("row_key", "named", F.when(F.col("named"), extracted(WITH_LONE)).otherwise(F.col("found")).alias("found"))
    each = found.select("row_key", "named", F.posexplode("found").alias("place", "mention")).groupBy("row_key", "place").agg(F.first("mention").alias("mention"), F.first("named").alias("named"))
    return _described(each)


def replace(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, n_entities, text`` of every row, entities replaced by surrogates."""
    found = stored(mentions(docs), "mentions")
    parts = stored(_parts(found), "name-parts")
    of = surrogates(_entities(found, parts), key)
    plain = found.where("kind not in ('name', 'lone')").join(of.drop("gender", "script"), ["kind", "canonical"])
    written = plain.select("row_key", "place", _written().alias("new"), F.lit(True).alias("changed")).unionByName(_rewritten(found, parts, of))
    # a row's mentions are bounded by its own text
    written = written.join(found.select("row_key", "place", "named"), ["row_key", "place"])
    lists = written.groupBy("row_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda x: x["new"]).alias("news"), F.count_if("changed").alias("n"), F.first("named").alias("named"))
    rows = _keyed(docs).join(lists, "row_key", "left")
    pieces = F.when(F.col("named"), F.split("text", WITH_LONE, -1)).otherwise(F.split("text", ANY, -1))
    text = F.when(F.col("news").isNull(), F.col("text")).otherwise(F.array_join(F.zip_with(pieces, "news", lambda p, n: F.concat(F.coalesce(p, F.lit("")), F.coalesce(n, F.lit("")))), ""))
    return rows.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_entities"), text.alias("text"))
