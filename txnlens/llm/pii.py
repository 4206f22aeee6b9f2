"""Surrogates for personal data, with DataFrame functions only.

Detected entities (e-mail, telephone, IP, card, IBAN and social-security numbers,
credentials, and persons named after titles or by a common given name) are replaced
by made-up ones of the same type and format: letters stay letters of the same case,
digits digits, separators stay. A number is a card only with a valid check digit and
in the groups in which cards are written, and an IBAN only with the length of its
country and a valid remainder; other numbers stay. Card numbers keep their first digit
and a valid check digit, IBANs their country and a valid remainder, names keep gender
(from the title, else the given name) and script, e-mail domains become example
domains. A person's mention takes in all titles, initials, particles and names up to
its end; initials become other initials, particles stay.

A surrogate is a function of a secret key and the normalised entity, so an entity
gets the same one wherever it occurs, and a surname the same one with or without a
given name or title. The table of distinct entities is checked: a surrogate that
another entity has, or that is itself an entity of the data, is drawn again with
the next counter until none is left. Given names and surnames count as one kind there.
The key has no default; registered queries take it from KEY_SETTING of the session.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm.tables import cut

# Titles and the gender they tell, degrees after them, given names, and syllables of surnames.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Lord", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "Господин", "г-н"],
    "f": ["Mrs", "Ms", "Miss", "Lady", "Mme", "Madame", "Mlle", "Mademoiselle", "Frau", "Señora", "Señorita", "Sra", "Srta", "Doña", "Dra", "Profesora",
          "Signora", "Госпожа", "г-жа"],
    "u": ["Dr", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Professeur", "Profesor", "Dipl.-Ing", "Mx", "Rev"],
}
DEGREES = "med phil rer nat jur habil dent vet oec pol h.c".split()
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Alice Berta Clara Diana Emma Flora Greta Helena Ida Julia Karin Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera".split(),
    ("latin", "u"): "Alex Andy Charlie Chris Dana Eli Jamie Jo Kai Kim Lee Max Nico Robin Sam Sascha Sidney Taylor Toni Val".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Иван Кирилл Максим Олег Павел Роман Юрий".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга Полина Юлия".split(),
    ("cyrillic", "u"): "Женя Саша Валя Шура".split(),
}
SYLLABLES = {
    "latin": "ba be bri do dre fa fen gal go hal hen jo kel kri la lin lo mar mel nor ol pen ra ros sal ste ta tor ul van ver win".split(),
    "cyrillic": "ба бе бо ва ви го гра да до жу за ка ки ко ла ло ма ме ми на но па пе ра ро са со ти то фе ша щу".split(),
}
ENDINGS = {"latin": "ck der dt lan ler man mer nd ner rd sen son ston tz well yer".split(),
           "cyrillic": "бин ков лин лов мин нов рин ров син тов".split()}

#: Given names that tell a person without a title, with those above of one gender.
COMMON_GIVEN = {
    "m": ("Alejandro Alexander Andreas Andrew Anthony Antoine Antonio Benjamin Bernard Carlos Charles Christopher Daniel Diego Dieter Edward Fernando "
          "Francisco François Frank George Gerhard Guillaume Hans Heinrich Henri Henry Jacques James Javier Jean Jeffrey Johann John Jorge Joseph José Juan "
          "Julien Jürgen Kevin Klaus Louis Luis Manuel Markus Matthew Matthias Michael Michel Miguel Nicolas Patrick Pedro Peter Philippe Pierre Rafael Richard "
          "Sebastian Stefan Stephen Steven Ulrich Uwe Walter William Wolfgang").split(),
    "f": ("Amélie Andrea Angela Anna Anne Barbara Beatriz Brigitte Camille Carmen Caroline Catherine Charlotte Chloé Christine Claudia Cristina Dorothy "
          "Elena Elisabeth Elizabeth Emily Françoise Gabriele Hannah Heike Inés Ingrid Isabel Jennifer Jessica Katharina Lucía Margaret Marie Mary Monika "
          "Nathalie Patricia Pilar Renate Sabine Sandra Sarah Sophie Susan Susanne Sylvie Ursula Valérie").split(),
}
#: Words before a surname that belong to it.
PARTICLES = ["van der", "van den", "van de", "van", "von und zu", "von der", "von dem", "von den", "von", "de la", "de los", "de las", "de", "del", "della", "di",
             "da", "dos", "du", "des", "le", "la", "ten", "ter", "bin", "ibn", "al", "af", "av", "y"]
#: Months and weekdays, which are no further names of a person, and which stay where they stand without a title.
DATES = ("January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
         "Januar Februar März Mai Juni Juli Oktober Dezember Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag").split()
#: Lengths of IBANs by country.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH DE GB GE IE ME RS", 23: "AE GI IL TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU",
    31: "MT SC"}
KEY_SETTING, TEST_KEY = "txnlens.surrogates.key", "key-for-tests"
_LATIN, _ACCENTED, _CYRILLIC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ÀÁÂÄÅÇÈÉÊÍÑÓÖØÚÜ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"


def surrogate_key(spark: SparkSession) -> str:
    """The key that the session names in KEY_SETTING; a test key where it names none."""
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def _either(words: list[str]) -> str:
    """The words as alternatives, longer ones first."""
    return "|".join(w.replace(".", r"\.") for w in sorted(words, key=lambda w: (-len(w), w)))


_TITLE = _either([t for group in TITLES.values() for t in group]) + r"|M(?=\.[ ]\p{Lu}\p{Ll})"
#: One or more titles with what belongs to them, up to the name.
_TITLES = rf"(?:(?:{_TITLE})\.?[ ])+(?:(?:{_either(DEGREES)})\.[ ])*"
_KNOWN = _either(sorted({n for (_, g), names in GIVEN.items() if g != "u" for n in names} | {n for names in COMMON_GIVEN.values() for n in names}))
_DATE = rf"(?:{_either(DATES)})(?!\p{{L}})"
# a possessive 's is no part of a name
_NAME = r"(?:[dl]['’])?\p{Lu}(?:\p{L}+(?:(?!['’]s(?!\p{L}))['’-]\p{L}+)*|(?:(?!['’]s(?!\p{L}))['’-]\p{L}+)+)"
_INITIALS = r"(?:\p{Lu}\.(?:-?\p{Lu}\.)*[ ]?)*"
_CORE = rf"{_INITIALS}(?:(?:{_either(PARTICLES)})[ ])*{_NAME}"
_MORE = rf"(?:[ ](?!{_DATE}){_CORE})"
_HEX = "[0-9A-Fa-f]"
#: At most seven groups on both sides of the two colons.
_COMPRESSED = "|".join([f"(?:{_HEX}{{1,4}}:){{1,7}}:", *(f"(?:{_HEX}{{1,4}}:){{1,{7 - n}}}(?::{_HEX}{{1,4}}){{1,{n}}}" for n in range(1, 7)),
                        f":(?::{_HEX}{{1,4}}){{1,7}}"])
_IBANS = "|".join(f"(?:{'|'.join(names.split())})\\d{{2}}(?:[ ]?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_COUNTRIES.items())
#: (type, pattern), in the order in which they are tried at a place.
PATTERNS = [
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}"),
    ("credential", r"(?i:(?<![\p{L}\p{N}])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[ ]{0,3}[=:][ ]{0,3}[\"']?)[^\s\"']{8,}+"),
    ("key", r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20,}|(?=[0-9]*+[a-f])[0-9a-f]{32,}+)(?![\p{L}\p{N}])"),
    # no version number
    ("ip", r"(?<![\d.])(?<!(?i:version|release|build|ver\.|\bv)[ ]?)(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"),
    ("ip", r"(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])"),
    # compressed: some group has four digits (so no slice such as [::2]), and a decimal digit or a third group tells it from a::b in code
    ("ip", rf"(?<![\p{{L}}\p{{N}}:])(?=[0-9A-Fa-f:]*?(?<![0-9A-Fa-f]){_HEX}{{4}}(?!{_HEX}))(?=[A-Fa-f:]*+\d|[A-Fa-f:]*?[A-Fa-f]:[A-Fa-f])"
           rf"(?:{_COMPRESSED})(?![\p{{L}}\p{{N}}:]|\.\d)"),
    ("iban", rf"(?<![\p{{L}}\p{{N}}])(?:{_IBANS})(?![\p{{L}}\p{{N}}])"),  # its remainder: _pattern
    ("phone", r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\d(])(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"),
    ("card", r"(?<![\p{L}\p{N}.])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])"),  # its check digit and groups: _pattern
    ("person", rf"(?<!\p{{L}})(?:{_TITLES}{_CORE}{_MORE}*|(?:{_KNOWN})(?:-\p{{Lu}}\p{{L}}+)?(?!\p{{L}}){_MORE}+)"),
]


def _any(*kinds: str) -> str:
    return "|".join(f"(?:{p})" for k, p in PATTERNS if k in kinds)


# what can begin at a letter is tried at the beginnings of words only, the rest at digits, brackets and signs; a text's own cards come last
_ANY = (rf"(?<![\p{{L}}\p{{N}}])(?=[\p{{L}}_%+-])(?:{_any('email', 'credential', 'key', 'ip')}|(?=\p{{Lu}}|г-)(?:{_any('person')}))"
        rf"|(?=[\d(+]|::)(?:{_any('email', 'key', 'ip', 'phone', 'ssn')}")
#: Numbers joined by single spaces or hyphens, and whether a text can have a card at all.
_RUN = r"(?<![\p{L}\p{N}.])\d++(?![\p{L}\p{N}])(?:[ -]\d++(?![\p{L}\p{N}]))*+"
_MAY_HAVE_CARD = r"\d(?:[ -]?\d){12}"
#: Digits of the groups in which cards are written.
CARD_GROUPS = [("13,19",), ("4", "4", "4", "4", "1,3"), ("6", "13"), ("4", "4", "4", "4"), ("8", "8"), ("4", "6", "5"), ("4", "5", "6"),
               ("4", "4", "4", "1,3"), ("4", "6", "4"), ("4", "4", "5")]
_CREDENTIAL_HEAD = r"^(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth) {0,3}[=:] {0,3}[\"']?"
_MAY_HAVE_IBAN = r"[A-Z]{2}\d{2}[ ]?[A-Z0-9]"
_IBAN_AT = rf"(?<![\p{{L}}\p{{N}}])(?=((?:{_IBANS}))(?![\p{{L}}\p{{N}}]))"
_PERSON_HEAD = rf"^{_TITLES}"
TYPES = ("email", "phone", "ip", "card", "iban", "ssn", "credential", "key", "person")


def _pattern(text: Column) -> Column:
    """The pattern of the mentions in ``text``.

    Its cards stand in it as they are written, the longest first: a pattern cannot tell
    a check digit, and a number beside a card must neither hide it nor go with it.
    """
    # by looking ahead, numbers that overlap are all found
    shapes = [r"(?<!\d)(?=(" + "[ -]".join(rf"\d{{{n}}}" for n in groups) + r")(?!\d))" for groups in CARD_GROUPS]
    found = F.transform(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), lambda run: F.concat(
        *[F.regexp_extract_all(run, F.lit(shape), F.lit(1)) for shape in shapes]))
    cards = F.filter(F.array_distinct(F.flatten(found)), lambda c: F.pmod(_luhn_sum(F.regexp_replace(c, "[ -]", "")), F.lit(10)) == 0)
    longest = F.transform(F.sort_array(F.transform(cards, lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))), asc=False), lambda x: x["c"])
    either = F.concat(F.lit(r"|(?<![\p{L}\p{N}.])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    ibans = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(_IBAN_AT), F.lit(1))), lambda c: _remainder(F.regexp_replace(c, " ", "")) == 1)
    accounts = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(ibans, "|"), F.lit(r")(?![\p{L}\p{N}])|"))
    return F.concat(F.when(text.rlike(_MAY_HAVE_IBAN), F.when(F.size(ibans) > 0, accounts).otherwise("")).otherwise(""), F.lit(_ANY),
                    F.when(text.rlike(_MAY_HAVE_CARD), F.when(F.size(longest) > 0, either).otherwise("")).otherwise(""), F.lit(")"))


def _type(raw: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS:
        hit = raw.rlike(f"^(?:{pattern})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("key")


def _other_initials(text: Column, key: str) -> Column:
    """Capitals replaced along a keyed ring of their alphabet: none stays, and different ones stay different."""
    source, target = "", ""
    for alphabet in (_LATIN, _ACCENTED, _CYRILLIC):
        ring = "".join(sorted(alphabet, key=lambda c: hashlib.sha256(f"{key}|initial|{c}".encode()).digest()))
        source, target = source + ring, target + ring[1:] + ring[:1]
    return F.translate(text, source, target)


def _tokens(kind: Column, raw: Column, key: str) -> Column:
    """Entities inside a mention: (type, value) and the text before each, as an array of structs.

    Of a person, the last name and those after a particle are surnames, the others
    given names; initials and particles are text before a name.
    """
    title = F.regexp_extract(raw, _PERSON_HEAD, 0)
    names = F.split(F.regexp_replace(raw, _PERSON_HEAD, ""), " ")
    told = F.when(title.rlike(rf"(?<!\p{{L}})(?:{_either(TITLES['m'])})(?!\p{{L}})|^M\."), "m").when(
        title.rlike(rf"(?<!\p{{L}})(?:{_either(TITLES['f'])})(?!\p{{L}})"), "f").otherwise("u")
    known = {g: [n.lower() for (_, x), names_ in GIVEN.items() if x == g for n in names_] + [n.lower() for n in COMMON_GIVEN[g]] for g in "mf"}

    def given(word: Column) -> Column:
        first = F.lower(F.substring_index(word, "-", 1))
        return F.concat(F.lit("given_"), F.when(told != "u", told).when(first.isin(known["m"]), "m").when(first.isin(known["f"]), "f").otherwise("u"))

    def step(acc: Column, x: Column) -> Column:
        word = x["word"]
        particle, initial = word.rlike(r"^\p{Ll}+$"), word.rlike(r"^(?:\p{Lu}\.-?)+$")
        before = F.concat(acc["before"], F.when(acc["first"], "").otherwise(" "))
        late = acc["late"] | particle
        one = F.struct(F.when(x["last"] | late, "surname").otherwise(given(word)).alias("kind"), word.alias("value"), before.alias("before"))
        text = F.when(initial, F.concat(before, _other_initials(word, key))).when(particle, F.concat(before, word)).otherwise("")
        return F.struct(text.alias("before"), F.lit(False).alias("first"), late.alias("late"),
                        F.when(particle | initial, acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    words = F.transform(names, lambda w, i: F.struct(w.alias("word"), (i == F.size(names) - 1).alias("last")))
    start = F.struct(title.alias("before"), F.lit(True).alias("first"), F.lit(False).alias("late"),
                     F.expr("cast(array() as array<struct<kind:string,value:string,before:string>>)").alias("out"))
    head = F.when(kind == "credential", F.regexp_extract(raw, _CREDENTIAL_HEAD, 0)).otherwise("")
    one = F.array(F.struct(kind.alias("kind"), F.substring(raw, F.length(head) + 1, F.length(raw)).alias("value"), head.alias("before")))
    person = F.aggregate(words, start, step, lambda acc: acc["out"])
    return F.when(kind == "person", person).otherwise(one)


def normal_form(kind: Column, value: Column) -> Column:
    """What makes two values the same entity: case for addresses and names, separators for numbers."""
    return (F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, r"[^\d+]", ""))
            .when(kind == "iban", F.regexp_replace(value, " ", ""))
            .when(kind.isin("email", "ip", "surname", "given_m", "given_f", "given_u"), F.lower(value)).otherwise(value))


def _pick(seed: Column, i: Column | int, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, i if isinstance(i, Column) else F.lit(i)), F.lit(n))


def _choice(items: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (at + 1).cast("int"))


def _letters(alphabet: str, at: Column) -> Column:
    return F.substring(F.lit(alphabet), (at + 1).cast("int"), 1)


def _redraw(text: Column, seed: Column, hexadecimal: Column) -> Column:
    """Every letter and digit drawn anew, kind by kind; hexadecimal text stays hexadecimal."""

    def plain(c: Column, i: Column) -> Column:
        i = i + 1
        return (F.when(c.rlike("[0-9]"), _letters("0123456789", _pick(seed, i, 10)))
                .when(c.rlike(r"\p{Lu}"), _letters("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _pick(seed, i, 26)))
                .when(c.rlike(r"\p{L}"), _letters("abcdefghijklmnopqrstuvwxyz", _pick(seed, i, 26))).otherwise(c))

    def digit(c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9a-f]"), _letters("0123456789abcdef", _pick(seed, i + 1, 16))).otherwise(plain(c, i))

    # what holds for the whole text is asked outside of the functions, which run for each character
    chars = F.split(text, "")
    return F.when(F.length(text) > 0, F.array_join(F.when(hexadecimal, F.transform(chars, digit)).otherwise(F.transform(chars, plain)), "")).otherwise("")


def _luhn_sum(digits: Column) -> Column:
    """Check sum of a digit string whose last digit is the check digit."""

    def worth(c: Column, i: Column) -> Column:
        d = c.try_cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    each = F.transform(F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1))), worth)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _remainder(iban: Column) -> Column:
    """What an IBAN leaves modulo 97, 1 if it is valid: letters count as two digits, the first four characters come last."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def more(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), more)


def with_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, norm, counter) with the surrogate of each as ``made``; another counter gives another one.

    What several kinds use is computed in steps of its own.
    """
    kind, norm, counter, seed, drawn = (F.col(c) for c in ("kind", "norm", "counter", "seed", "drawn"))
    # an e-mail's domain depends on the domain alone, so that addresses of one host stay together
    domain = F.substring_index(norm, "@", -1)
    secret = kind.isin("credential", "key")
    hexadecimal = (secret & norm.rlike("^[0-9]*+[a-f][0-9a-f]*+$")) | ((kind == "ip") & norm.contains(":"))
    steps = (entities.withColumn("seed", F.sha2(F.concat_ws("|", F.lit(key), kind, norm, counter.cast("string")), 256))
             .withColumn("place", F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256))
             .withColumn("source", F.when(kind == "email", F.substring_index(norm, "@", 1)).otherwise(norm))
             .withColumn("drawn", _redraw(F.col("source"), seed, hexadecimal))
             .withColumn("body", F.when(kind == "card", F.concat(F.substring(norm, 1, 1), F.substring(drawn, F.lit(2), F.length(norm) - 2))))
             .withColumn("valid", F.when(kind == "card", F.pmod(_luhn_sum(norm), F.lit(10)) == 0))
             .withColumn("check", F.when(F.col("valid"), F.pmod(10 - F.pmod(_luhn_sum(F.concat("body", F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))
                         .otherwise(F.substring(drawn, -1, 1)))
             .withColumn("account", F.when(kind == "iban", F.substring(drawn, F.lit(5), F.length(norm))))
             .withColumn("script", F.when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")))

    country = F.substring(norm, 1, 2)
    iban = F.concat(country, F.lpad((98 - _remainder(F.concat(country, F.lit("00"), "account"))).cast("string"), 2, "0"), "account")
    size = F.greatest(F.lit(4), F.length(F.substring_index(domain, ".", 1)))
    host = F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: _letters("abcdefghijklmnopqrstuvwxyz", _pick(F.col("place"), i, 26))), "")
    email = F.concat(drawn, F.lit("@"), host, F.lit(".example."), _choice(["com", "net", "org"], _pick(F.col("place"), 0, 3)))
    octets = F.concat_ws(".", *[(_pick(seed, i, 254) + 1).cast("string") for i in range(4)])
    first = (_pick(seed, 0, 8) + 2).cast("string")  # no number begins with 0 or 1
    phone = (F.when(norm.startswith("+1"), F.concat(F.lit("+1"), first, F.substring(drawn, 4, 64)))
             .when(norm.startswith("+"), F.concat(F.substring(norm, 1, 3), first, F.substring(drawn, 5, 64)))
             .otherwise(F.concat(first, F.substring(drawn, 2, 64))))
    # a secret with few letters and digits has few surrogates of its form: later draws are longer
    plain = F.when(norm.rlike(r"[\p{L}\p{N}]") & (counter < 4), drawn).otherwise(F.concat(drawn, F.substring(seed, 1, 12)))
    key_text = F.when(norm.startswith("AKIA"), F.concat(F.lit("AKIA"), F.substring(drawn, 5, 64))).otherwise(plain)

    def in_script(make) -> Column:
        return F.when(F.col("script") == "cyrillic", make("cyrillic")).otherwise(make("latin"))

    def surname(s: str) -> Column:
        parts = F.transform(F.sequence(F.lit(1), (F.lit(2) + F.floor(counter / 4)).cast("int")), lambda i: _choice(SYLLABLES[s], _pick(seed, i, len(SYLLABLES[s]))))
        end = _choice(ENDINGS[s], _pick(seed, 0, len(ENDINGS[s])))
        if s == "cyrillic":
            end = F.concat(end, F.when(norm.rlike("[ая]$"), "а").otherwise(""))
        return F.initcap(F.concat(F.array_join(parts, ""), end))

    def given(gender: str):
        # a second and third name joined by a hyphen once single names are taken
        return lambda s: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(counter / 2).cast("int")), lambda i: _choice(
            GIVEN[s, gender], _pick(seed, i, len(GIVEN[s, gender])))), "-")

    made = (F.when(kind == "email", email).when((kind == "ip") & ~norm.contains(":"), octets).when(kind == "phone", phone)
            .when(kind == "card", F.concat("body", "check")).when(kind == "iban", iban)
            .when(kind == "ssn", F.concat(F.lit("9"), F.substring(drawn, 2, 64))).when(kind == "key", key_text).when(kind == "credential", plain)
            .when(kind == "surname", in_script(surname)).when(kind == "given_m", in_script(given("m")))
            .when(kind == "given_f", in_script(given("f"))).when(kind == "given_u", in_script(given("u"))).otherwise(drawn))
    return steps.withColumn("made", made).drop("seed", "place", "source", "drawn", "body", "valid", "check", "account", "script")


def surrogate_table(entities: DataFrame, key: str, rounds: int = 64) -> DataFrame:
    """(kind, norm, made) of the distinct entities (kind, norm), one surrogate each.

    In each round the entities still without one draw it; a draw holds if no entity
    of its kind (names of persons are one kind) has it as its own value, no earlier round gave it away, and no other
    entity drew it (of several, the smallest keeps it). Names and numbers have room
    that grows with the counter or is far larger than any table of entities; should
    ``rounds`` not do, an error says so rather than a surrogate being shared.
    """
    family = F.when(F.col("kind").isin("surname", "given_m", "given_f", "given_u"), "name").otherwise(F.col("kind")).alias("family")
    known = cut(entities.select("kind", "norm").distinct())
    waiting, done = known.withColumn("counter", F.lit(0)), None
    for _ in range(rounds):
        drawn = cut(with_surrogates(waiting, key)
                    .select("*", normal_form(F.col("kind"), F.col("made")).alias("made_norm"), family))
        taken = known.select(family, F.col("norm").alias("made_norm"))
        if done is not None:
            taken = taken.unionByName(done.select("family", "made_norm"))
        owner = drawn.groupBy("family", "made_norm").agg(F.min(F.struct("kind", "norm")).alias("owner"))
        good = (drawn.join(owner, ["family", "made_norm"]).filter("owner.kind = kind and owner.norm = norm").drop("owner")
                .join(taken, ["family", "made_norm"], "left_anti").select("kind", "norm", "made", "family", "made_norm"))
        done = cut(good if done is None else done.unionByName(good))
        waiting = cut(drawn.join(done, ["kind", "norm"], "left_anti").select("kind", "norm", (F.col("counter") + 1).alias("counter")))
        if waiting.isEmpty():
            return done.select("kind", "norm", "made")
    raise RuntimeError(f"no distinct surrogates after {rounds} rounds")


def _formatted(kind: Column, value: Column, made: Column) -> Column:
    """The surrogate in the mention's format: its separators, and its case for addresses and names."""
    def at(i: Column) -> Column:
        return F.substring(value, i, F.lit(1))

    places = F.sequence(F.lit(1), F.length(value))
    separated = F.aggregate(places, F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), lambda acc, i: F.struct(
        F.concat(acc["s"], F.when(at(i).rlike("[0-9A-Za-z+]"), F.substring(made, acc["n"] + 1, F.lit(1))).otherwise(at(i))).alias("s"),
        F.when(at(i).rlike("[0-9A-Za-z+]"), acc["n"] + 1).otherwise(acc["n"]).alias("n")), lambda acc: acc["s"])
    upper = (value == F.upper(value)) & (value != F.lower(value)) & (F.length(value) > 1)
    return (F.when(kind.isin("phone", "card", "ssn", "iban"), separated)
            .when(kind.isin("email", "ip", "surname", "given_m", "given_f", "given_u") & upper, F.upper(made)).otherwise(made))


def replace_entities(docs: DataFrame, *, key: str, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``docs`` with surrogates in ``text``, and the table of entities (kind, norm, made).

    All columns and rows stay as they are but for the text. A surname or given name
    of a person in a row is replaced wherever else it stands in that row, all in one
    pass, so no surrogate is replaced again; months and weekdays stay. Null and empty texts, and texts without entities, are unchanged; rows with
    null or repeated doc_ids are treated one by one; equal texts get equal texts; an
    empty table gives an empty table.
    """
    here = F.col(text).cast("string")
    pattern = _pattern(here)
    mentions = (docs.select(F.col(doc_id).cast("string").alias("row"), F.xxhash64(here).alias("hash"),
                            F.regexp_extract_all(here, pattern, F.lit(0)).alias("raw")).filter(F.size("raw") > 0))
    # rows with the same id and text have the same mentions
    mentions = mentions.groupBy("row", "hash", "raw").agg(F.count("*").alias("copies")).select(
        "row", "hash", F.posexplode("raw").alias("place", "raw"))
    kind = _type(F.col("raw"))
    tokens = cut(mentions.withColumn("kind", kind).select("row", "hash", "place", F.posexplode(_tokens(F.col("kind"), F.col("raw"), key)).alias("step", "t"))
                 .select("row", "hash", "place", "step", "t.*").withColumn("norm", normal_form(F.col("kind"), F.col("value"))))
    table = surrogate_table(tokens, key)
    made = tokens.join(table, ["kind", "norm"]).withColumn("new", _formatted(F.col("kind"), F.col("value"), F.col("made")))
    person = F.col("kind").isin("surname", "given_m", "given_f", "given_u")
    steps = made.groupBy("row", "hash", "place").agg(
        F.array_sort(F.collect_list(F.struct("step", F.concat("before", "new").alias("new")))).alias("steps"),
        F.collect_set(F.when(person, F.struct(F.col("value").alias("old"), F.col("new").alias("new")))).alias("names"))
    rows = (steps.select("row", "hash", "place", F.array_join("steps.new", "").alias("new"), "names").groupBy("row", "hash")
            .agg(F.array_sort(F.collect_list(F.struct("place", "new"))).alias("news"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
            .withColumn("names", F.array_sort("names")))
    # a name that is both a given name and a surname of the row has one surrogate between the mentions
    first = F.filter("names", lambda x, i: (i == 0) | (F.get(F.col("names"), i - 1)["old"] != x["old"]))
    rows = rows.withColumn("names", F.filter(first, lambda x: ~x["old"].isin(DATES)))
    longest = F.transform(F.array_sort(F.transform("names", lambda x: F.struct((-F.length(x["old"])).alias("n"), x["old"].alias("old")))), lambda x: x["old"])
    either = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.transform(longest, lambda old: F.concat(F.lit(r"\Q"), old, F.lit(r"\E"))), "|"), F.lit(r")(?!\p{L})"))
    rows = rows.select(F.col("row").alias("__row"), F.col("hash").alias("__hash"), F.col("news.new").alias("__new"),
                       F.when(F.size("names") > 0, either).alias("__names"), F.map_from_entries("names").alias("__other"))
    joined = docs.join(rows, F.col(doc_id).cast("string").eqNullSafe(F.col("__row")) & (F.xxhash64(here) == F.col("__hash")), "left")

    def renamed(part: Column) -> Column:
        hits = F.transform(F.regexp_extract_all(part, F.col("__names"), F.lit(0)), lambda old: F.element_at("__other", old))
        return F.when(F.col("__names").isNull(), part).otherwise(
            F.array_join(F.zip_with(F.split(part, F.col("__names"), -1), hits, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))

    # the text between mentions, each followed by its surrogate; names are replaced there too
    between = F.transform(F.split(here, pattern, -1), renamed)
    whole = F.array_join(F.zip_with(between, F.col("__new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    columns = [F.when(F.col("__new").isNull(), F.col(c)).otherwise(whole).alias(c) if c == text else docs[c] for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size("__new"), F.lit(0)).alias("__entities")), table


def replace_pii(docs: DataFrame, *, key: str) -> DataFrame:
    """``docs`` with surrogates in the text and, where there is such a column, n_chars counted anew."""
    out = replace_entities(docs, key=key)[0]
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("__entities")


def surrogate_report(docs: DataFrame, *, key: str) -> DataFrame:
    """(doc_id, text, n_entities, changed) of every row: the text with surrogates and the mentions replaced."""
    out = replace_entities(docs.select("doc_id", "text"), key=key)[0]
    return out.select("doc_id", "text", F.col("__entities").alias("n_entities"), (F.col("__entities") > 0).alias("changed"))
