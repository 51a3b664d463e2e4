"""PII surrogates with DataFrame functions alone.

One pattern finds entities in whole texts. Each entity's letters and digits go through a keyed
four-round Feistel network over its own character classes, so equal entities get equal surrogates,
different ones of a format get different ones, and kind, format and case stay. Names are built from
lists of the same gender and script. A check over the distinct entities of all documents then finds
surrogates that two entities share or that repeat the entity, and draws those anew.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Titles by gender: f, m (fixed values).
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
}
#: First parts of surrogate names by script and gender, and their further syllables (invented).
NAMES = {
    "latin": {"f": ["Al", "Bri", "Cel", "Dor", "El", "Fio", "Gre", "Hel"], "m": ["Ad", "Bor", "Con", "Dam", "Ed", "Fre", "Gor", "Hu"]},
    "cyrillic": {"f": ["Ал", "Бе", "Ве", "Га", "Да", "Ев", "Жа", "Зо"], "m": ["Ар", "Бо", "Ви", "Гле", "Де", "Его", "Ив", "Ки"]},
    "greek": {"f": ["Αλ", "Βε", "Γε", "Δω", "Ελ", "Ζω", "Ηρ", "Θε"], "m": ["Αν", "Βα", "Γα", "Δη", "Ευ", "Ζη", "Θω", "Ιω"]},
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ku", "la", "me", "ni", "po", "ra", "se", "ti", "vo", "wen", "xan", "zel"],
    "cyrillic": ["ба", "де", "фи", "го", "ку", "ла", "ме", "ни", "по", "ра", "се", "ти", "во", "вен", "хан", "зел"],
    "greek": ["βα", "δε", "φι", "γο", "κου", "λα", "με", "νι", "πο", "ρα", "σε", "τι", "βο", "νεν", "χαν", "ζελ"],
}
#: Endings that make a name's gender plain.
ENDINGS = {"latin": {"f": "a", "m": "on"}, "cyrillic": {"f": "ова", "m": "ов"}, "greek": {"f": "ου", "m": "ος"}}

_TITLE = "(?:" + "|".join(sorted((t for x in TITLES.values() for t in x), key=len, reverse=True)) + ")"
#: Capital letters that stand for a name: an initial's surrogate comes from its own line.
INITIALS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
_INITIAL = "(?:(?:[" + "".join(INITIALS) + r"]\.)++|[" + "".join(INITIALS) + r"](?=[  ]))"
_NAME = r"(?:\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:-\p{Lu}\p{L}+)*+)"
#: Words between names, which stay.
_BETWEEN = r"(?:(?:von|van|de|del|di|da|dos|du)(?:[  ](?:der|den|la|las|los))?)"
_HEAD = rf"{_TITLE}\.?[  ](?:(?:Dr|Prof)\.?[  ])*+"
_LINKS = rf"(?:(?:{_INITIAL}|{_BETWEEN})[  ])*+"
#: A title and all names after it, words and initials, up to the last word. Another title begins another person.
PERSON = rf"(?<![\p{{L}}\p{{N}}]){_HEAD}{_LINKS}{_NAME}(?:[  ]{_LINKS}(?!{_TITLE}\.?[  ]){_NAME})*+"
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: IPv4, and IPv6 in full or with one gap
ADDRESS = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])|(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9])|" + (_NATIONAL := r"(?<![0-9.+-])(?:[0-9]{3}([.-])[0-9]{3}[.-][0-9]{4}|0[0-9]{2,4}[ /-][0-9]{3,4}[ -]?[0-9]{3,4})(?![0-9]|[.-][0-9])")
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![0-9])[0-9]{4}(?:([ -]?)[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<=(?i:token|password|passwd|secret|api_key|apikey) {0,2}[=:] {0,2}[\"']{0,1})[A-Za-z0-9_/+~.-]{7,}[A-Za-z0-9_/+~-]"
ENTITY = "|".join((PERSON, EMAIL, SECRET, IBAN, ADDRESS, CARD, PHONE, SSN))
#: What any entity has at least: texts without it are passed on unread by the full pattern.
HINT = rf"[0-9@]|::|(?i:token|password|passwd|secret|api_?key) {{0,2}}[=:]|{_TITLE}\.?[ \u00A0](?:\p{{Lu}}|(?:von|van|de|del|di|da|dos|du)[ \u00A0])"
#: Rounds in which colliding surrogates are drawn anew, each twice as safe as all names of a kind are many.
REDRAWS = 16
#: Columns that a result has besides those of the documents.
OWN_COLUMNS = ("n_entities", "entity_kinds")
#: The setting that holds the key.
KEY = "spark.lapforge.pii.key"


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def _byte(digest: Column, i: Column) -> Column:
    """Byte ``i`` (from 0, again from the start after 32) of a hex digest."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shift(text: Column, digest: Column, hexadecimal: Column) -> Column:
    """Digits and lower-case letters moved on within their class (a-f alone for hexadecimal ones)."""

    def move(c: Column, i: Column, digest: Column) -> Column:
        code, by = F.ascii(c), _byte(digest, i)
        digit = F.char(48 + F.pmod(code - 48 + by, F.lit(10)))
        few = F.char(97 + F.pmod(code - 97 + by, F.lit(6)))
        letter = F.char(97 + F.pmod(code - 97 + by, F.lit(26)))
        return F.when(c.between("0", "9"), digit).when(hexadecimal, few).otherwise(letter)

    return _let(digest, lambda d: F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: move(c, i, d)), ""))


def _feistel(text: Column, key: Column, hexadecimal: Column) -> Column:
    """A keyed permutation of the texts of [0-9a-z] with equal classes of characters at equal places. ``text``: bound by :func:`_let`."""
    half = (F.length(text) / 2).cast("int")
    halves = F.array(F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)))

    def rounds(bound: Column) -> Column:
        tweak, state = bound[0], F.array(bound[1], bound[2])
        even = lambda r: lambda s: F.array(_shift(s[0], _digest(tweak, F.lit(str(r)), s[1]), hexadecimal), s[1])
        odd = lambda r: lambda s: F.array(s[0], _shift(s[1], _digest(tweak, F.lit(str(r)), s[0]), hexadecimal))
        for r in range(4):
            state = _let(state, odd(r) if r % 2 else even(r))
        return _let(state, lambda s: F.concat(s[0], s[1]))

    return _let(F.concat(F.array(F.concat_ws("-", key, F.length(text).cast("string"))), halves), rounds)


def _core(text: Column) -> Column:
    """Letters and digits alone, in lower case: what spellings of one entity share."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def _into(form: Column, core: Column) -> Column:
    """``core``'s characters at the letters and digits of ``form``, in its case."""

    own, old = F.filter(F.split(core, ""), lambda c: c != ""), F.regexp_extract_all(form, F.lit("[A-Za-z0-9]"), F.lit(0))
    put = F.transform(F.arrays_zip(F.split(form, "[A-Za-z0-9]", -1).alias("p"), old.alias("o"), own.alias("c")), lambda z: F.concat(z["p"], F.coalesce(F.when(z["o"].between("A", "Z"), F.upper(z["c"])).otherwise(z["c"]), F.lit(""))))
    return F.array_join(put, "")


def _permuted(text: Column, key: Column) -> Column:
    def spell(v: Column) -> Column:
        mixed = _let(_core(v), lambda core: _let(core.rlike("^[0-9a-f]*$"), lambda few: _feistel(core, key, few)))
        return _let(mixed, lambda m: _into(v, m))

    return _let(text, spell)


def _luhn(digits: Column) -> Column:
    """Luhn's check digit for digits that it shall follow."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    twice = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(twice, F.lit(0), lambda s, x: s + x), F.lit(10))


def _mod97(text: Column) -> Column:
    """The number that digits and capital letters (10 to 35) spell, modulo 97."""
    add = lambda s, c: F.when(c.between("0", "9"), s * 10 + F.ascii(c) - 48).otherwise(s * 100 + F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda s, c: F.pmod(add(s, c), F.lit(97)))


def kind_of(value: Column) -> Column:
    return (
        F.when(value.rlike(f"^{_TITLE}\\.?[ \\u00A0]"), "person")
        .when(value.contains("@"), "email")
        .when(value.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$") | value.rlike("^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]+$"), "address")
        .when(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(value.rlike("^[+(][0-9]") | value.rlike(f"^{_NATIONAL}$"), "phone")
        .when(value.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{8,}$") & value.rlike("^.{4} ?[A-Z0-9]{4}(?: ?[A-Z0-9]{4}){1,6}(?: ?[A-Z0-9]{1,3})?$"), "iban")
        .when(value.rlike("^[0-9][0-9 -]{11,}$"), "card")
        .otherwise("secret")
    )


def identity(kind: Column, value: Column) -> Column:
    """What all mentions of one entity share: its kind, and its letters and digits, or name and gender."""
    name = F.lower(F.regexp_replace(value, f"^{_TITLE}\\.?[ \\u00A0]", ""))
    own = F.when(kind == "person", F.concat(_gender(value), F.lit(":"), name)).when(kind.isin("email", "secret", "address"), F.when(kind == "email", F.lower(value)).otherwise(value)).otherwise(_core(value))
    return F.concat(kind, F.lit(":"), own)


def _gender(value: Column) -> Column:
    return F.when(value.rlike("^(?:" + "|".join(TITLES["f"]) + r")\.?[  ]"), "f").otherwise("m")


def _person(value: Column, key: Column, attempt: Column) -> Column:
    """A title with a drawn name. Each further draw has two syllables more, so there are names for any number of entities."""
    title = F.regexp_extract(value, f"^({_TITLE}\\.?[ \\u00A0])", 1)
    name = F.regexp_replace(value, f"^{_TITLE}\\.?[ \\u00A0]", "")
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def build(d: Column) -> Column:
        out = None
        for s in NAMES:
            for g in ("f", "m"):
                parts = [F.array(*map(F.lit, NAMES[s][g]))[F.pmod(_byte(d, F.lit(0)), F.lit(8))]]
                more = F.transform(F.sequence(F.lit(1), 4 + 2 * attempt), lambda k: F.array(*map(F.lit, SYLLABLES[s]))[F.pmod(_byte(d, k), F.lit(16))])
                built = F.concat(title, *parts, F.array_join(more, ""), F.lit(ENDINGS[s][g]))
                test = (script == s) & (_gender(value) == g)
                out = F.when(test, built) if out is None else out.when(test, built)
        return out

    return _let(_digest(key, _gender(value), F.lower(name)), build)


def surrogate(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """The surrogate of an entity under a key. ``attempt`` over 0 draws another."""
    own = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"))

    def email(v: Column) -> Column:
        host = F.regexp_extract(v, "@(.*)\\.[A-Za-z]+$", 1)
        # the local part and the host as one text, so that both depend on each other
        return F.concat(_permuted(F.concat(F.substring_index(v, "@", 1), F.lit("@"), host), own), F.lit("."), F.substring_index(v, ".", -1))

    def address(v: Column) -> Column:
        return F.when(v.contains(":"), _permuted(v, own)).otherwise(octets(v))

    def octets(v: Column) -> Column:
        state = F.transform(F.split(v, "\\."), lambda x: x.cast("int"))
        bytes_of = lambda s, r, k: [F.pmod(s[2 - k + j] + _byte(_digest(own, F.lit(str(r)), s[k].cast("string"), s[k + 1].cast("string")), F.lit(j)), F.lit(256)) for j in (0, 1)]
        even = lambda r: lambda s: F.array(*bytes_of(s, r, 2), s[2], s[3])
        odd = lambda r: lambda s: F.array(s[0], s[1], *bytes_of(s, r, 0))
        for r in range(4):
            state = _let(state, odd(r) if r % 2 else even(r))
        return F.array_join(state.cast("array<string>"), ".")

    def phone(v: Column) -> Column:
        code = F.regexp_extract(v, "^(\\+[0-9]{1,3}(?=[ .(-])|\\+[0-9]|0|)", 1)
        return F.concat(code, _permuted(F.substring(v, F.length(code) + 1, F.length(v)), F.concat_ws("|", own, code)))

    def card(v: Column) -> Column:
        return _let(_core(v), lambda digits: numbered(v, digits))

    def numbered(v: Column, digits: Column) -> Column:
        middle = F.substring(digits, F.lit(2), F.length(digits) - 2)
        # the last digit keeps its distance from Luhn's check digit: valid numbers stay valid
        off = F.substring(digits, F.length(digits), F.lit(1)).cast("int") - _luhn(F.substring(digits, F.lit(1), F.length(digits) - 1))
        head = F.concat(F.substring(digits, 1, 1), _let(middle, lambda m: _feistel(m, F.concat_ws("|", own, F.substring(digits, 1, 1)), F.lit(False))))
        return _let(head, lambda h: _into(v, F.concat(h, F.pmod(_luhn(h) + off, F.lit(10)).cast("string"))))

    def iban(v: Column) -> Column:
        """The country stays, and what the check digits lack to be right."""
        country = F.substring(v, 1, 2)
        right = lambda account: 98 - _mod97(F.concat(account, country, F.lit("00")))

        def put(account: Column) -> Column:
            off = F.substring(v, 3, 2).cast("int") - right(F.upper(_core(F.substring(v, F.lit(5), F.length(v)))))
            check = F.pmod(right(F.upper(_core(account))) + off, F.lit(97))
            return F.concat(country, F.lpad(F.when(check < 2, check + 97).otherwise(check).cast("string"), 2, "0"), account)

        return _let(_permuted(F.substring(v, F.lit(5), F.length(v)), F.concat_ws("|", own, country)), put)

    def secret(v: Column) -> Column:
        head = F.when(v.rlike("^AKIA[0-9A-Z]{16}$"), "AKIA").otherwise("")
        return F.concat(head, _permuted(F.substring(v, F.length(head) + 1, F.length(v)), own))

    return (
        F.when(kind == "person", _person(value, own, attempt))
        .when(kind == "email", email(value))
        .when(kind == "address", address(value))
        .when(kind == "phone", phone(value))
        .when(kind == "card", card(value))
        .when(kind == "iban", iban(value))
        .when(kind == "ssn", _permuted(value, own))
        .otherwise(secret(value))
    )


def _pieces(kind: Column, mention: Column) -> Column:
    """A person's title, names and what is between them; any other mention is one piece."""
    head = F.regexp_extract(mention, f"^{_HEAD}", 0)
    names = F.regexp_extract_all(F.substring(mention, F.length(head) + 1, F.length(mention)), F.lit("[ \\u00A0]|[^ \\u00A0.]+\\.?"), F.lit(0))
    return F.when(kind == "person", F.concat(F.array(head), names)).otherwise(F.array(mention))


def _is_name(piece: Column) -> Column:
    return piece.rlike(f"^{_NAME}$")


def _atom(kind: Column, mention: Column, piece: Column) -> Column:
    """The entity that a piece names: a title with one name, so that full and last names share the last one."""
    return F.when(kind == "person", F.concat(F.regexp_extract(mention, f"^{_TITLE}\\.?[ \\u00A0]", 0), piece)).otherwise(piece)


def _atoms(mention: Column) -> Column:
    return _let(kind_of(mention), lambda k: F.transform(F.filter(_pieces(k, mention), lambda p: (k != "person") | _is_name(p)), lambda p: _atom(k, mention, p)))


def _initial(piece: Column, key: str) -> Column:
    """Initials move on within their alphabet by a keyed number of letters."""
    by = int.from_bytes(hashlib.sha256(f"{key}|initial".encode()).digest()[:8])
    moved = "".join(x[1 + by % (len(x) - 1) :] + x[: 1 + by % (len(x) - 1)] for x in INITIALS)
    return F.when(piece.rlike("^[" + "".join(INITIALS) + r"]\.?$"), F.translate(piece, "".join(INITIALS), moved)).otherwise(piece)


def _rewrite(mention: Column, key: str, attempt) -> Column:
    """A mention with surrogates. ``attempt``: of an entity."""

    def put(kind: Column, piece: Column) -> Column:
        bare = lambda s: F.when(kind == "person", F.regexp_replace(s, f"^{_TITLE}\\.?[ \\u00A0]", "")).otherwise(s)
        drawn = _let(_atom(kind, mention, piece), lambda a: _let(surrogate(kind, a, key, attempt(a)), bare))
        return F.when((kind == "person") & ~_is_name(piece), _initial(piece, key)).otherwise(drawn)

    return _let(kind_of(mention), lambda k: F.array_join(F.transform(_pieces(k, mention), lambda p: put(k, p)), ""))


def entities(docs: DataFrame) -> DataFrame:
    """(kind, value) of every entity in the column ``text``, as often as it is mentioned. Each of a person's names is one."""
    hits = docs.where(F.col("text").rlike(HINT)).select(F.explode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("mention"))
    return hits.select(F.explode(_atoms(F.col("mention"))).alias("value")).select(kind_of(F.col("value")).alias("kind"), "value")


def redraws(found: DataFrame, key: str) -> DataFrame:
    """Collision check over all distinct entities: (id, attempt) of those that need another draw.

    Two entities must not share a surrogate, and none may be its own. Of those that share one, the
    first by its identity keeps it.
    """
    own = found.distinct().withColumn("id", identity(F.col("kind"), F.col("value"))).groupBy("id", "kind").agg(F.min("value").alias("value"))
    drawn = own.withColumn("attempt", F.lit(0)).withColumn("to", _let(surrogate(F.col("kind"), F.col("value"), key, F.lit(0)), lambda s: identity(F.col("kind"), s)))
    drawn = common.materialize(drawn, "surrogates")

    def losers(rows: DataFrame) -> DataFrame:
        least = rows.groupBy("to").agg(F.min(F.struct(F.col("id") == F.col("to"), "id")).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1 or keep.col1")
        return rows.join(least, "to").where("id = to or id <> keep.id").select("id", "kind", "value", "attempt")

    for _ in range(REDRAWS):
        bad = common.materialize(losers(drawn), "collisions")
        if bad.isEmpty():
            break
        again = bad.withColumn("attempt", F.col("attempt") + 1).withColumn("to", _let(surrogate(F.col("kind"), F.col("value"), key, F.col("attempt")), lambda s: identity(F.col("kind"), s)))
        drawn = common.materialize(drawn.join(bad.select("id"), "id", "left_anti").unionByName(again.select(drawn.columns)), "surrogates")
    else:
        raise RuntimeError("surrogates still collide")
    return drawn.where("attempt > 0").select("id", "attempt")


def key_of(spark: SparkSession) -> str:
    """The key in the session's setting KEY; where it is unset a random one is put there, which the session keeps."""
    found = spark.conf.get(KEY, None)
    if not found:
        found = secrets.token_hex(16)
        spark.conf.set(KEY, found)
    return found


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates for the entities in its text column, and n_entities and entity_kinds.

    Kinds: address (IPv4, IPv6), card (13 to 19 digits), email, iban, person (after a title), phone
    (international, with an area code in brackets or after 0, or 3-3-4 digits), secret and ssn. Who has
    the key can undo all surrogates but names, so it has no default. A mention's spelling is kept:
    case, separators, country code, card brand and the validity of check digits. All
    names after a title are replaced, each by its own surrogate: a last name keeps its one with and
    without a first name.
    n_entities counts mentions, entity_kinds are the distinct kinds, sorted and joined by commas.

    Null and empty texts stay as they are with 0 entities. All other columns and repeated rows stay;
    its working columns take names that are free. A column of ``docs`` named
    n_entities or entity_kinds is replaced. An empty table gives an empty result.
    """
    text = F.col(text_col)
    again = redraws(entities(docs.select(text.cast("string").alias("text"))), key)
    hint = F.coalesce(text.rlike(HINT), F.lit(False))
    values = F.when(hint, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found, by, drawn = (common.free_name(docs, x) for x in ("pii", "pii_text", "pii_again"))
    out = docs.withColumn(found, values)
    if again.isEmpty():
        attempt = lambda v: F.lit(0)
    else:
        mentions = docs.where(hint).select(F.sha2(text, 256).alias(by), F.explode(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), _atoms))).alias("v"))
        by_text = mentions.distinct().withColumn("id", identity(kind_of(F.col("v")), F.col("v"))).join(again, "id").groupBy(by).agg(F.map_from_entries(F.collect_set(F.struct("v", "attempt"))).alias(drawn))
        out = out.withColumn(by, F.when(F.size(found) > 0, F.sha2(text, 256))).join(by_text, by, "left")
        attempt = lambda v: F.coalesce(F.col(drawn)[v], F.lit(0))
    new = F.transform(found, lambda v: _rewrite(v, key, attempt))
    pieces = F.split(text, ENTITY, -1)
    joined = F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), F.concat(new, F.array(F.lit(""))).alias("s")), lambda z: F.concat(z["p"], z["s"])), "")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(found, kind_of))), ",")
    out = out.withColumns({text_col: F.when(F.size(found) > 0, joined).otherwise(text), "n_entities": F.size(found).cast("long"), "entity_kinds": kinds})
    return out.drop(found, by, drawn)


def op9(spark, sf_dir: str) -> DataFrame:
    """All documents with surrogates for their entities."""
    return replace_entities(common.documents(spark, sf_dir), key_of(spark)).select("doc_id", "text", "n_entities", "entity_kinds")
