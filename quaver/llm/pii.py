"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent.

Detected: e-mail addresses, IPv4 addresses, payment card numbers, phone numbers, access
keys, assigned secrets (password=..., token = "..."), and names after a title. A mention
is made of units in a canonical form: the local part and the domain of an address (lower
case), each word of a name, the digits of a number, the value of an assignment. Equal
units get the same replacement in all mentions, documents and formats, so Jane Doe and
Doe keep their common word, and two addresses of one company their domain.

The replacement of a unit is a keyed permutation of the strings of its format: each
character stands for one place in its alphabet (digit, letter of one case, vowel or
consonant of one script, ...), and a Feistel network over the even and the odd places adds
to either half what a keyed hash gives of the other. So units of one format get distinct
strings of that format by construction, however many of them there are and even where
they fill it. Kept as they are: separators, a domain's last label, an access key's prefix,
a card's issuer digit (its check digit is made valid, or wrong by as much as it was),
a phone number's country code, and endings that show the gender of a Cyrillic or Greek
family name. First names get an ending of their gender and script.

All replacements are then checked together: one that is itself a unit of the table, or
that a unit of another format has got, is dealt again, from strings one character longer
(cards, access keys and IPv4 addresses keep their length and change the permutation). The
strings of a format multiply with each character, so few units are left after the first
pass and none after a few; there is no limit of rounds. Only where IPv4 addresses are
concerned may one get another's (256^4 is all there are), never its own.

Everything is DataFrame operations. The texts are searched once: rows and what was found
in them are written, texts without entities go straight through, and those with entities
are joined with their replacements on a 128-bit hash of the text, so copies of a text
share the work and a hot text or unit is split by Spark.

Edge cases: a null text stays null, an empty one empty; a very long one is replaced
whole. Repeated rows stay repeated. Of two units that want one string, the first by kind
and value gets it. Text around the entities is kept to the character. An empty table gives
an empty one; other columns pass through unchanged, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .workspace import materialize

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"
CARD = r"(?<![\w+.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\w|-\d)"
PHONE = r"(?<![\w.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w|-\d)"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?i:(?<![a-z0-9])(?:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_=-]{8,}[\"']?"
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Госпожа", "Κυρία")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
_TITLES = "|".join((*FEMALE, *MALE))
NAME = rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+){{0,2}}"
ENTITY = "|".join((EMAIL, SECRET, ACCESS_KEY, IPV4, CARD, PHONE, NAME))
#: Cheap test that every text with an entity meets.
HINT = rf"[@=:]|\d[ ().+-]*\d|AKIA|ASIA|(?:{_TITLES})\.? \p{{Lu}}"
_ASSIGNED = r"""(?i)^((?:password|passwd|secret|token|api[_-]?key)\s*[=:]\s*["']?)([A-Za-z0-9+/_=-]{8,})(["']?)$"""
_TITLED = rf"^((?:{_TITLES})\.? )(.*)$"

#: Rounds of the Feistel network; an even number, so that the halves end where they began.
ROUNDS = 6
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
HEX, AREA, OTHER_AREA, KEY = DIGITS + LOWER[:6], DIGITS[2:], DIGITS[:2], LOWER.upper() + DIGITS
PLAIN = (DIGITS, LOWER, LOWER.upper())
#: Letters of names that may stand for each other, by script: vowels, consonants, accented ones, signs.
_SMALL = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûü", "çñßšžčćłđřťďňľýÿ",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь", "ёіїєґ",
    "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "άέήίόύώϊϋΐΰ",
)
LETTERS = (*_SMALL, *("".join(dict.fromkeys(c.upper() for c in a if len(c.upper()) == 1)) for a in _SMALL))
_UNKNOWN_LETTER = f"[^{''.join(LETTERS)}'’-]"
#: Endings of family names that show a gender: fixed values.
_ENDING = "(?:ов|ев|ёв|ин|ын|ий|ой|ова|ева|ёва|ина|ына|ая|ος|ης|ας|ου|η|α|ά|ή)$"
#: Endings of made-up first names.
_GIVEN = {"latin": {"f": "na", "m": "ro"}, "cyrillic": {"f": "на", "m": "слав"}, "greek": {"f": "να", "m": "ος"}}
_MORE = {"latin": "na", "cyrillic": "на", "greek": "να"}
NAMES = ("first_f", "first_m", "last")
#: Tables of at most this many strings are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def _kind(e: Column) -> Column:
    titled = e.rlike(_TITLED)
    female = e.rlike(rf"^(?:{'|'.join(FEMALE)})\.? ")
    plain = F.regexp_replace(e, "[^0-9]", "")
    return (
        F.when(e.rlike(_ASSIGNED), "secret")
        .when(F.contains(e, F.lit("@")), "email")
        .when(titled & female, "name_f").when(titled, "name_m")
        .when(e.rlike("^(?:AKIA|ASIA)"), "key")
        .when(e.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(e.rlike(r"^[\d -]+$") & F.length(plain).between(13, 19), "card")
        .otherwise("phone")
    )


def _units(kind: Column, e: Column) -> Column:
    """Array of (kind, value): what a mention is made of, in order."""
    one = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    single = (
        F.when(kind == "secret", F.regexp_extract(e, _ASSIGNED, 2))
        .when(kind == "ip", F.array_join(F.transform(F.split(e, r"\."), lambda o: o.cast("int").cast("string")), "."))
        .when(kind.isin("card", "phone"), F.regexp_replace(e, "[^0-9]", ""))
        .otherwise(e)
    )
    address = F.lower(e)
    words = F.split(F.regexp_extract(e, _TITLED, 2), " ")
    first = F.when(kind == "name_f", "first_f").otherwise("first_m")
    return (
        F.when(kind == "email", F.array(one(F.lit("local"), F.substring_index(address, "@", 1)), one(F.lit("host"), F.substring_index(address, "@", -1))))
        .when(kind.startswith("name"), F.transform(words, lambda w, i: one(F.when((i == 0) & (F.size(words) > 1), first).otherwise("last"), w)))
        .otherwise(F.array(one(kind, single)))
    )


def _render(kind: Column, e: Column, surrogates: Column) -> Column:
    """The surrogates of a mention's units in its format."""
    only = F.get(surrogates, F.lit(0))
    before = lambda i: F.length(F.regexp_replace(F.substring(e, F.lit(1), i + 1), "[^0-9]", ""))
    digit = lambda c, i: F.when(c.rlike("[0-9]"), F.substring(only, before(i), F.lit(1))).otherwise(c)
    # a surrogate with more digits than the mention has ends with the rest of them
    digits = F.concat(F.array_join(F.transform(_characters(e), digit), ""), F.substring(only, before(F.length(e) - 1) + 1, F.length(only)))
    return (
        F.when(kind == "secret", F.concat(F.regexp_extract(e, _ASSIGNED, 1), only, F.regexp_extract(e, _ASSIGNED, 3)))
        .when(kind == "email", F.array_join(surrogates, "@"))
        .when(kind.startswith("name"), F.concat(F.regexp_extract(e, _TITLED, 1), F.array_join(surrogates, " ")))
        .when(kind.isin("card", "phone"), digits)
        .otherwise(only)
    )


def _characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def permute(s: Column, alphabets: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of the strings whose characters are in these alphabets, place by place; where the alphabet is empty the character stays.

    Even places and odd places are the halves of a Feistel network: a round adds to one half, place by place and modulo
    the size of the alphabet, a keyed hash of the other, and what was added can be told from the other half.
    """
    half = lambda a, odd: F.filter(a, lambda _, i: i % 2 == odd)

    def added(chars: Column, alphabet: Column, other: Column, r: Column) -> Column:
        seed = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), F.array_join(other, "")), 256)

        def one(c: Column, i: Column, seed: Column) -> Column:
            own = F.get(alphabet, i)
            at = F.pmod(F.position(c, own) - 1 + F.pmod(F.xxhash64(seed, i), F.length(own)), F.length(own)).cast("int")
            return F.when(own == "", c).otherwise(F.substring(own, at + 1, F.lit(1)))

        # the seed is bound to a variable, so that it is computed once a round
        return F.get(F.transform(F.array(seed), lambda x: F.transform(chars, lambda c, i: one(c, i, x))), 0)

    state = lambda a, b, c, d: F.struct(a.alias("now"), b.alias("own"), c.alias("other"), d.alias("their"))
    chars = _characters(s)
    start = state(half(chars, 0), half(alphabets, 0), half(chars, 1), half(alphabets, 1))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda x, r: state(x["other"], x["their"], added(x["now"], x["own"], x["other"], r), x["own"]))
    woven = lambda x: F.transform(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: F.get(F.when(i % 2 == 0, x["now"]).otherwise(x["other"]), F.floor(i / 2).cast("int")))
    # the result is bound to a variable as well
    return F.array_join(F.get(F.transform(F.array(end), woven), 0), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit, modulo 10."""
    n, digit = F.length(digits), lambda i: F.substring(digits, i, F.lit(1)).try_cast("int")
    doubled = lambda i: F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), digit(i) + 1)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, doubled(i)).otherwise(digit(i))) % 10


def _check_digit(body: Column) -> Column:
    return (F.lit(10) - _luhn(F.concat(body, F.lit("0")))) % 10


def _by_script(s: Column, choice: dict[str, str]) -> Column:
    return F.when(s.rlike(r"\p{IsCyrillic}"), choice["cyrillic"]).when(s.rlike(r"\p{IsGreek}"), choice["greek"]).otherwise(choice["latin"])


def _in(c: Column, alphabets: tuple[str, ...]) -> Column:
    found = F.when(F.lit(False), "")
    for a in alphabets:
        found = found.when(F.contains(F.lit(a), c), a)
    return found.otherwise("")


def _with_surrogate(units: DataFrame, key: str, attempt: int) -> DataFrame:
    """(kind, value, surrogate): what the key gives each unit in this attempt."""
    kind, value, s = F.col("kind"), F.col("value"), F.col("s")
    name = kind.isin(*NAMES)
    octets = F.array_join(F.transform(F.split(value, r"\."), lambda o: F.lpad(F.hex(o.cast("long")), 2, "0")), "")
    # letters of a script without an alphabet here: the word becomes a code of 24 letters first
    code = F.initcap(F.translate(F.substring(F.sha2(F.concat_ws("|", F.lit(key), value), 256), 1, 24), HEX, LOWER[:16]))
    base = F.when(kind == "ip", F.lower(octets)).when(name & value.rlike(_UNKNOWN_LETTER), code).otherwise(value)
    out = units.withColumn("s", base)
    if attempt:
        more = F.substring(F.repeat(_by_script(s, _MORE), attempt), 1, attempt)
        grown = F.when(name, F.concat(F.substring(s, 1, 1), more, F.substring(s, F.lit(2), F.length(s)))).when(kind == "phone", F.concat(s, F.lit("0" * attempt)))
        out = out.withColumn("s", grown.when(kind.isin("local", "host", "secret"), F.concat(F.lit("a" * attempt), s)).otherwise(s))
    n, chars = F.length("s"), _characters(s)
    each = lambda f: F.transform(chars, f)
    ending = F.length(F.regexp_extract(s, _ENDING, 0))
    fixed = F.when((kind == "last") & (ending + 2 <= n), n - ending).otherwise(n)
    label = n - F.length(F.substring_index(s, ".", -1)) - 1
    area = F.length(value) - 10
    hexa = value.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}$")
    leading = lambda c: F.when(F.contains(F.lit(AREA), c), AREA).otherwise(OTHER_AREA)
    alphabets = (
        F.when(name, each(lambda c, i: F.when(i >= fixed, "").otherwise(_in(c, LETTERS))))
        .when((kind == "ip") | ((kind == "secret") & hexa), each(lambda c: F.lit(HEX)))
        .when(kind == "key", each(lambda c, i: F.when(i < 4, "").otherwise(KEY)))
        .when(kind == "card", each(lambda c, i: F.when((i == 0) | (i == n - 1), "").otherwise(DIGITS)))
        .when(kind == "phone", each(lambda c, i: F.when(i < area, "").when(i == area, leading(c)).otherwise(DIGITS)))
        .when(kind == "host", each(lambda c, i: F.when(i >= label, "").otherwise(_in(c, PLAIN))))
        .otherwise(each(lambda c: _in(c, PLAIN)))
    )
    out = out.withColumn("alphabets", alphabets)
    out = out.withColumn("made", permute(s, F.col("alphabets"), F.concat_ws("|", kind, F.lit(str(attempt))), key))
    made = F.col("made")
    body = F.substring(made, F.lit(1), F.length(made) - 1)
    wrong = F.substring(value, -1, 1).try_cast("int") - _check_digit(F.substring(value, F.lit(1), F.length(value) - 1))  # 0 on a valid card
    surrogate = (
        F.when(kind == "first_f", F.concat(made, _by_script(made, {k: v["f"] for k, v in _GIVEN.items()})))
        .when(kind == "first_m", F.concat(made, _by_script(made, {k: v["m"] for k, v in _GIVEN.items()})))
        .when(kind == "ip", F.array_join(F.transform(F.array(*map(F.lit, (1, 3, 5, 7))), lambda i: F.conv(F.substring(made, i, F.lit(2)), 16, 10)), "."))
        .when(kind == "card", F.concat(body, F.pmod(_check_digit(body) + wrong, F.lit(10)).cast("string")))
        .otherwise(made)
    )
    return out.select("kind", "value", surrogate.alias("surrogate"))


OWN, DEALT, NEW = 0, 1, 2


def deal(units: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): no two get the same string, and none one that is a value."""
    taken = units.select(F.col("value").alias("surrogate"), F.lit(OWN).alias("tag"))
    todo, parts, attempt = units, [], 0
    while True:
        made = materialize(_with_surrogate(todo, key, attempt), "made")
        seen = taken
        if attempt:
            wanted = made.select("surrogate").distinct()
            few = made.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
            seen = taken.join(F.broadcast(wanted) if few else wanted, "surrogate", "left_semi")
        all_ = made.select("kind", "value", "surrogate", F.lit(NEW).alias("tag")).unionByName(seen, allowMissingColumns=True)
        same = W.Window.partitionBy("surrogate")
        is_own = (F.col("kind") != "ip") & (F.max(F.col("tag") == OWN).over(same))
        first = F.row_number().over(same.orderBy(F.col("tag").desc(), "kind", "value")) == 1
        free = first & ~is_own & ~F.max(F.col("tag") == DEALT).over(same) & (F.col("surrogate") != F.col("value"))
        judged = materialize(all_.withColumn("free", free).where(F.col("tag") == NEW).select("kind", "value", "surrogate", "free"), "dealt")
        got = judged.where("free").select("kind", "value", "surrogate")
        parts.append(got)
        todo = judged.where("not free").select("kind", "value")
        if todo.isEmpty():
            break
        taken = taken.union(got.select("surrogate", F.lit(DEALT).alias("tag")))
        attempt += 1
    out = parts[0]
    for got in parts[1:]:
        out = out.union(got)
    return out


def replace_pii(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; with ``count``, also a column of that name with the number of entities."""
    t = F.col("d")[text]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    hinted = F.coalesce(t.rlike(HINT), F.lit(False))
    rows = rows.withColumn("e", F.when(hinted, F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = materialize(rows, "searched")
    hits = rows.where(F.size("e") > 0).withColumn("a", F.xxhash64(F.lit(1), t)).withColumn("b", F.xxhash64(F.lit(2), t))
    mentions = hits.groupBy("a", "b").agg(F.first("e").alias("e")).select("a", "b", F.posexplode("e").alias("i", "m"))
    mentions = mentions.withColumn("is", _kind(F.col("m")))
    each = materialize(mentions.select("a", "b", "i", "m", "is", F.posexplode(_units(F.col("is"), F.col("m"))).alias("j", "u")).select("a", "b", "i", "m", "is", "j", "u.*"), "units")
    dealt = deal(materialize(each.select("kind", "value").distinct(), "entities"), key)
    said = each.join(dealt, ["kind", "value"]).repartition("a", "b")
    in_order = lambda at, what: F.transform(F.sort_array(F.collect_list(F.struct(at, what))), lambda x: x[what])
    said = said.groupBy("a", "b", "i").agg(F.first("m").alias("m"), F.first("is").alias("is"), in_order("j", "surrogate").alias("p"))
    said = said.withColumn("s", _render(F.col("is"), F.col("m"), F.col("p")))
    found = materialize(said.groupBy("a", "b").agg(in_order("i", "s").alias("s")), "found")
    woven = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.array(F.get("p", i), F.coalesce(F.get("s", i), F.lit(""))))
    changed = hits.join(found, ["a", "b"]).withColumn("p", F.split(t, ENTITY, -1)).select("d", F.array_join(F.flatten(woven), "").alias("t"), F.size("e").alias("n"))
    same = rows.where(F.size("e") == 0).select("d", t.alias("t"), F.lit(0).alias("n"))
    out = [F.col("t").alias(c) if c == text else F.col("d")[c].alias(c) for c in docs.columns]
    return same.unionByName(changed).select(*out, *([F.col("n").alias(count)] if count else []))
