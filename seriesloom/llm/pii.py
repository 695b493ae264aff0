"""Personal data replaced by surrogates of the same kind.

Mentions are found by patterns and reduced to what they name; each distinct entity gets one
surrogate, derived from a key, that every mention of it wears in its own format: separators, case
and script stay, names keep their gender. Surrogates that two entities share, or that equal an
entity of the corpus, are derived anew until there are none.

A name is known by a title before it; each of its words is an entity. In a text with titled names
their words are also found without a title, where they are capitalised. Names that no title
precedes anywhere in their text are not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.staging import drop_staged, staged

_WORD = r"\p{Lu}[\p{L}\p{M}'’-]+"
#: Titles before names, with the gender they show.
TITLES = {
    "male": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "Г-н", "Господин", "Κύριος"),
    "female": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Signora", "Г-жа", "Госпожа", "Κυρία"),
    "unknown": ("Dr", "Prof", "Mx", "Д-р"),
}
_TITLES = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_MORE = "(?:(?:Dr|Prof|Д-р)\\.? )*+"
#: Small words before a name, which stay.
PARTICLES = ("de", "da", "di", "del", "della", "dos", "du", "van", "von", "zu", "bin", "ibn", "al", "ten", "ter", "la", "las", "los", "le", "den", "dem", "der")
_SMALL = "(?:(?:de|da|di|del|della|dos|du|van|von|zu|bin|ibn|al|ten|ter)(?: (?:la|las|los|le|den|dem|der|de))? ){0,2}+"
_LETTERS = r"A-Za-z\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{M}"
_HEX = "[0-9A-Fa-f]"
#: An address of version 6 that is given out or local: its first group is whole, and no more than seven colons follow each other's groups.
_IPV6 = (
    rf"(?<![0-9A-Za-z:.])(?=(?:{_HEX}*:){{2,7}}{_HEX}*(?![0-9A-Za-z]|:[0-9A-Za-z:]))(?:[23]{_HEX}{{3}}|[Ff][CDcd]{_HEX}{{2}}|[Ff][Ee][89ABab]{_HEX})"
    rf"(?:(?::{_HEX}{{1,4}}){{7}}|(?::{_HEX}{{1,4}}){{0,6}}::(?:{_HEX}{{1,4}}(?::{_HEX}{{1,4}}){{0,5}})?)(?![0-9A-Za-z]|:[0-9A-Za-z:]|\.[0-9])"
)
_FIRST = "".join(sorted({t[0] for ts in TITLES.values() for t in ts}))
#: Patterns of each type, tried in this order. A run of more than 128 hex digits is a secret if a letter is among them.
PATTERNS = {
    "email": rf"(?<![{_LETTERS}])[{_LETTERS}0-9._%+-]{{1,64}}+@[{_LETTERS}0-9-]{{1,63}}(?:\.[{_LETTERS}0-9-]{{1,63}}){{0,8}}\.[{_LETTERS}]{{2,24}}",
    "secret": r"(?:(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}+|(?=[0-9]*+[a-f])[0-9a-f]{129,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)(?![A-Za-z0-9]))|(?<=[\"'])(?<=(?:secret|token|passwd|password|apikey|api_key)[ \t]{0,2}[=:][ \t]{0,2}[\"'])[^\"'\s]{8,}+(?=[\"'])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mac": r"(?<![A-Za-z0-9:])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![A-Za-z0-9:])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])|" + _IPV6,
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,5}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?=[{_FIRST}])(?:{_TITLES})(?![\p{{L}}\p{{N}}])\.? {_MORE}{_SMALL}{_WORD}(?: {_SMALL}{_WORD}){{0,2}}",
}
#: Attempts after which a surrogate gets one more digit or letter, and again after as many: a format whose values are nearly all taken has no room.
WIDEN = 4
#: A word of a name.
PART = r"(?<![\p{L}\p{M}'’])(?:\p{L}[\p{L}\p{M}]*(?:['’]\p{L}[\p{L}\p{M}]+)+|\p{L}[\p{L}\p{M}]+)"
#: Any mention but names; none begins within an ASCII word, which spares most places the patterns.
ANY = f"(?<![A-Za-z0-9])(?:{'|'.join(f'(?:{p})' for k, p in PATTERNS.items() if k != 'name')})"
#: What a text with a mention holds at least, quick to look for.
HINT = rf"[0-9@]|[Ff][CDEcde]{_HEX}{{2}}:|(?<![A-Za-z0-9])(?:AKIA|gh[pousr]_|sk-|xox[abprs]-|[a-f]{{32}})|[=:][ \t]{{0,2}}[\"']|(?=[{_FIRST}])(?:{_TITLES})\.? {_MORE}{_SMALL}\p{{Lu}}"
#: Syllables from which names are built, and endings that show gender, by script.
SYLLABLES = {
    "latin": (("ba", "ce", "di", "fo", "ga", "he", "ji", "ko", "la", "me", "ni", "po", "ra", "se", "ti", "vo"), {"male": ("n", "r"), "female": ("na", "ra"), "unknown": ("l", "s")}),
    "cyrillic": (("ба", "ве", "ди", "го", "да", "ле", "ми", "но", "па", "ре", "си", "то", "ва", "зе", "ки", "фо"), {"male": ("н", "р"), "female": ("на", "ра"), "unknown": ("ль", "с")}),
    "greek": (("βα", "γε", "δι", "θο", "κα", "λε", "μι", "νο", "πα", "ρε", "σι", "το", "φα", "χε", "ζι", "ξο"), {"male": ("ς", "ος"), "female": ("α", "η"), "unknown": ("ν", "ρ")}),
}


def kind_of(mention: Column) -> Column:
    """The type of a mention: the first whose pattern fits all of it."""
    return F.coalesce(*(F.when(F.rlike(mention, F.lit(rf"^(?:{p})$")), F.lit(k)) for k, p in PATTERNS.items() if k != "secret"), F.lit("secret"))


def _untitled(mention: Column) -> Column:
    return F.regexp_replace(mention, rf"^(?:{_TITLES})\.? {_MORE}", "")


def name_words(text: Column) -> Column:
    """Array of (word, gender): the words of a text's titled names in lower case; the last of several shows no gender."""

    def words(mention: Column) -> Column:
        found = F.filter(F.regexp_extract_all(_untitled(mention), F.lit(PART), F.lit(0)), lambda x: ~x.isin(*PARTICLES))
        found = F.transform(found, F.lower)
        found = F.when(F.size(found) == 0, F.array(F.lower(_untitled(mention)))).otherwise(found)
        shown = lambda i: F.when((i == 0) | (i < F.size(found) - 1), gender_of(mention)).otherwise("unknown")
        return F.transform(found, lambda x, i: F.struct(x.alias("word"), shown(i).alias("gender")))

    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)), words)))


def mention_pattern(words: Column) -> Column:
    """The pattern of any mention in a text whose names have these words: they are mentions wherever they are capitalised or stand behind a hyphen."""
    known = F.concat(F.lit(rf"{ANY}|(?<![\p{{L}}\p{{M}}])(?:(?=\p{{Lu}})|(?<=\p{{L}}-))(?iu:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{M}])"))
    return F.when(F.size(words) == 0, ANY).otherwise(known)


def _groups_of(address: Column) -> Column:
    """An address of version 6 with all its eight groups, of four digits each."""
    halves = F.split(F.lower(address), "::")
    left, right = F.split(F.element_at(halves, 1), ":"), F.when((F.size(halves) > 1) & (F.element_at(halves, -1) != ""), F.split(F.element_at(halves, -1), ":")).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), ":")


def entity_of(kind: Column, mention: Column) -> Column:
    """What a mention names, whatever its format: digits of numbers, letters in lower case, all groups of an address; of names what follows the title."""
    plain = F.regexp_replace(mention, r"[^0-9A-Za-z]", "")
    name = F.lower(_untitled(mention))
    return F.when(kind == "email", F.lower(mention)).when(kind.isin("iban", "mac"), F.upper(plain)).when(kind.isin("card", "ssn", "phone"), F.regexp_replace(mention, "[^0-9]", "")).when(kind == "name", name).when((kind == "ip") & F.contains(mention, F.lit(":")), _groups_of(mention)).otherwise(mention)


def gender_of(mention: Column) -> Column:
    """The gender that a name's title shows; `unknown` for other mentions."""
    shown = [F.when(F.rlike(mention, F.lit(rf"^(?:{'|'.join(sorted(TITLES[g], key=len, reverse=True))})\.? ")), F.lit(g)) for g in ("male", "female")]
    return F.coalesce(*shown, F.lit("unknown"))


def script_of(entity: Column) -> Column:
    return F.when(F.rlike(entity, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.rlike(entity, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


def _nibbles(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """256 hex digits that depend on the key, the entity and the attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), entity)
    return F.concat(*(F.sha2(F.concat(F.lit(f"{i}\x1f"), seed).cast("binary"), 256) for i in range(4)))


def _like(pattern: Column, digest: Column) -> Column:
    """`pattern` with digits for digits and letters for letters of its script and case; the digest repeats beyond 128 characters."""
    scripts = {"[0-9]": "0123456789", "[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"(?=\p{IsCyrillic})\p{Ll}": "абвгдежзиклмнопрстуфхцчшщэюя", r"(?=\p{IsCyrillic})\p{Lu}": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", r"(?=\p{IsGreek})\p{Ll}": "αβγδεζηθικλμνξοπρστυφχψω", r"(?=\p{IsGreek})\p{Lu}": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r"\p{Lu}": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"\p{L}": "abcdefghijklmnopqrstuvwxyz"}

    def drawn(c: Column, i: Column) -> Column:
        n = F.conv(F.substring(digest, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        pick = lambda letters: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
        return F.coalesce(*(F.when(F.rlike(c, F.lit(p)), pick(letters)) for p, letters in scripts.items()), c)

    return F.array_join(F.transform(F.split(pattern, ""), drawn), "")


def luhn(digits: Column) -> Column:
    """The sum by which cards are checked: a multiple of 10 where the number is valid."""
    n = F.char_length(digits)
    twice = lambda d, i: F.when((n - i) % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    return F.aggregate(F.transform(F.split(digits, ""), lambda c, i: twice(c.cast("int"), i)), F.lit(0), lambda a, x: a + x)


def mod97(iban: Column) -> Column:
    """The remainder by which IBANs are checked: 1 where the number is valid."""
    moved = F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _valid_card(entity: Column, made: Column) -> Column:
    """`made`, with its last digit such that it is valid where `entity` is."""
    body = F.substring(made, F.lit(1), F.char_length(made) - 1)
    return F.when(luhn(entity) % 10 == 0, F.concat(body, ((10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))).otherwise(made)


def _valid_iban(entity: Column, made: Column) -> Column:
    """`made`, with check digits such that it is valid where `entity` is."""
    rest = F.substring(made, F.lit(5), F.char_length(made))
    check = 98 - mod97(F.concat(F.substring(made, 1, 2), F.lit("00"), rest))
    return F.when(mod97(entity) == 1, F.concat(F.substring(made, 1, 2), F.lpad(check.cast("string"), 2, "0"), rest)).otherwise(made)


def surrogate_of(kind: Column, entity: Column, gender: Column, attempt: Column, d: Column) -> Column:
    """The surrogate of an entity, in the form that `entity_of` gives, from the digits `d` that `_nibbles` drew for it.

    IP addresses come from the reserved block 240.0.0.0/4, those of version 6 from 2001:db8::/32, in which groups of zeros stay; email domains from example.org; phone
    numbers and cards keep their first digit, IBANs their country; hex stays hex. Cards and IBANs
    with right check digits get such; social security numbers are in the ranges that are given out.
    Later attempts are longer: digits and letters more, an IP address of version 6 from 2001:db8::/32.
    """
    byte = lambda i: F.conv(F.substring(d, 2 * i + 1, 2), 16, 10).cast("int")
    wide = F.floor(attempt / WIDEN).cast("int")
    ip = F.concat_ws(".", *((x).cast("string") for x in (byte(0) % 15 + 240, byte(1), byte(2), byte(3))))
    ip = F.when(wide > 0, F.concat(F.lit("2001:0db8:"), F.concat_ws(":", *(F.substring(d, 4 * i + 1, 4) for i in range(6))))).otherwise(ip)
    own = lambda i: F.regexp_replace(F.substring(d, 4 * i + 1, 4), "^0000$", "0001")
    six = F.concat_ws(":", F.lit("2001:0db8"), *(F.when((wide == 0) & (F.substring(entity, 5 * i + 1, 4) == "0000"), "0000").otherwise(own(i)) for i in range(2, 8)))
    ip = F.when(F.contains(entity, F.lit(":")), six).otherwise(ip)
    email = F.concat(_like(F.substring_index(entity, "@", 1), d), F.lit("@"), F.translate(F.substring(d, F.lit(200), wide + 8), "0123456789", "ghijklmnop"), F.lit(".example.org"))
    hexed = F.substring(F.repeat(d, 4), F.lit(1), F.char_length(entity) + wide)
    longer = lambda x: F.concat(x, F.repeat(F.lit("0"), wide))
    secret = F.when(F.rlike(entity, F.lit("^[0-9a-f]+$")), hexed).otherwise(_like(longer(entity), d))
    number = _like(longer(entity), d)
    kept = F.concat(F.substring(entity, 1, 1), _like(longer(F.substring(entity, F.lit(2), F.char_length(entity))), d))
    part = lambda at, n, top: (F.conv(F.substring(d, at, n), 16, 10).cast("long") % top + 1).cast("string")
    area = F.conv(F.substring(d, 1, 6), 16, 10).cast("long") % 898 + 1  # 1 to 899 but for 666
    ssn = F.concat(F.lpad((area + (area >= 666).cast("long")).cast("string"), 3, "0"), F.lpad(part(7, 4, 99), 2, "0"), F.lpad(part(11, 8, 9999), 4, "0"))
    iban = F.concat(F.substring(entity, 1, 2), _like(longer(F.substring(entity, F.lit(3), F.char_length(entity))), d))

    def word(script: str, i: Column, last: Column) -> Column:
        syllables, ends = SYLLABLES[script]
        pick = lambda values, at: F.element_at(F.array(*(F.lit(v) for v in values)), F.conv(F.substring(d, at % 256 + 1, F.lit(1)), 16, 10).cast("int") % len(values) + 1)
        end = F.coalesce(*(F.when(gender == g, pick(e, i * 16 + 15)) for g, e in ends.items()))
        more = (F.when(attempt >= 2 * (k - 3), pick(syllables, i * 16 + k)).otherwise("") for k in range(4, 15))  # longer where short ones are taken
        return F.concat(*(pick(syllables, i * 16 + k) for k in range(4)), *more, F.when(last, F.lit("")).otherwise(end))

    size = F.size(F.split(entity, " "))
    names = {s: F.array_join(F.transform(F.sequence(F.lit(0), size - 1), _word_at(word, s, size)), " ") for s in SYLLABLES}
    name = F.coalesce(*(F.when(script_of(entity) == s, n) for s, n in names.items()))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "name", name)
        .when(kind == "secret", secret)
        .when(kind == "mac", F.upper(F.concat(F.lit("02"), F.substring(d, F.lit(1), 10 + 2 * wide))))
        .when(kind == "iban", _valid_iban(entity, iban))
        .when(kind == "phone", kept)
        .when(kind == "card", _valid_card(entity, kept))
        .when((kind == "ssn") & (wide == 0) & (F.char_length(entity) == 9), ssn)
        .otherwise(number)
    )


def _word_at(word, script: str, size: Column):
    return lambda i: word(script, i, (i > 0) & (i == size - 1))


def dressed(kind: Column, mention: Column, surrogate: Column) -> Column:
    """`surrogate` in the format of `mention`: its separators, its capitals, a name's title. What a longer surrogate has more stands at the end."""
    begin = F.struct(F.lit("").alias("done"), F.lit(1).alias("at"))
    step = lambda a, c: F.when(F.rlike(c, F.lit("[0-9A-Za-z]")), F.struct(F.concat(a["done"], F.substring(surrogate, a["at"], F.lit(1))).alias("done"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["done"], c).alias("done"), a["at"].alias("at")))
    put = lambda a: F.concat(a["done"], F.substring(surrogate, a["at"], F.char_length(surrogate)))
    digits = F.when(F.rlike(mention, F.lit("^[0-9]+$")), surrogate).otherwise(F.aggregate(F.split(mention, ""), begin, step, put))
    mac = F.when(mention == F.lower(mention), F.lower(digits)).otherwise(digits)
    title = F.regexp_extract(mention, rf"^((?:{_TITLES})\.? )", 1)
    rest = F.substring(mention, F.char_length(title) + 1, F.char_length(mention))
    name = F.concat(title, F.when((rest == F.upper(rest)) & (F.char_length(rest) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate)))
    email = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(surrogate)).otherwise(surrogate)
    full = F.when(F.rlike(mention, F.lit(rf"(?:^|:)0{_HEX}")), surrogate).otherwise(F.regexp_replace(surrogate, r"(?<![0-9a-f])0{1,3}(?=[0-9a-f])", ""))
    short = F.when(F.contains(mention, F.lit("::")), F.regexp_replace(full, "^((?:0*[1-9a-f][0-9a-f]*:)+)(?:0{1,4}(?::|$))+", "$1:")).otherwise(full)
    ip = F.when(~F.contains(surrogate, F.lit(":")), surrogate).when(mention == F.lower(mention), short).otherwise(F.upper(short))
    return F.when(kind.isin("card", "ssn", "phone", "iban"), digits).when(kind == "mac", mac).when(kind == "name", name).when(kind == "email", email).when(kind == "ip", ip).otherwise(surrogate)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) for distinct `entities` (kind, entity, gender), surrogates distinct and none an entity.

    Each round derives those anew that aren't the first of their surrogate by entity, or whose
    surrogate is an entity. Surrogates of later rounds are longer, so that rounds end however dense a format is.
    """
    now = staged(entities.withColumn("attempt", F.lit(0)), "entities")
    columns = [F.col(c) for c in ("kind", "entity", "gender", "attempt")]
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work a row
    while True:
        drawn = now.repartition(tasks, "kind", "entity").withColumn("d", _nibbles(F.col("kind"), F.col("entity"), F.col("attempt"), key))
        named = staged(drawn.withColumn("surrogate", surrogate_of(*columns, F.col("d"))).drop("d"), "surrogates")
        first = named.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "surrogate", "first")
        real = named.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        checked = named.join(first, ["kind", "surrogate"], "left").join(real, ["kind", "surrogate"], "left")
        clash = F.coalesce(F.col("real"), F.lit(False)) | F.coalesce(F.col("first.entity") != F.col("entity"), F.lit(False))
        after = staged(checked.withColumn("clash", clash).select("kind", "entity", "gender", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"), "surrogate", "clash"), "entities")
        drop_staged(now)
        drop_staged(named)
        if after.where("clash").limit(1).count() == 0:
            return after.select("kind", "entity", "surrogate")
        now = after.select("kind", "entity", "gender", "attempt")


def surrogates(docs: DataFrame, id_col="doc_id", text_col="text", key: str = "surrogates") -> DataFrame:
    """(id_col, text_col, n_mentions, kinds): every row of `docs`, with surrogates in place of personal data.

    One entity has one surrogate in all documents, and no two entities share one. A surrogate is as long as
    its entity unless nearly all values of that form are taken; then it gets longer. Each word of a titled
    name is an entity, also where its text repeats it without the title; adjacent ones count as one mention. Of a word with
    titles of both genders the more frequent one counts, at a tie the female. `kinds` lists the types found. Null texts stay
    null with no mentions; rows that repeat keep their number; other columns are not returned. Only
    texts with mentions are shuffled. The key should be secret: who knows it can test guesses.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    hint = F.coalesce(F.rlike("text", F.lit(HINT)), F.lit(False))
    none = lambda df, text: df.select("id", text.alias("text"), F.lit(0).alias("n_mentions"), F.array().cast("array<string>").alias("kinds"))
    known = F.transform("names", lambda n: n["word"])
    seen = rows.where(hint).withColumn("names", name_words(F.col("text"))).withColumn("pattern", mention_pattern(known))
    seen = seen.select("id", F.struct(F.xxhash64("id", "text", F.lit(1)).alias("a"), F.xxhash64(F.lit(2), "text", "id").alias("b")).alias("row"), "names", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("mentions"), F.split("text", F.col("pattern"), -1).alias("between"))
    seen = staged(seen, "mentions")
    some, plain = seen.where(F.size("mentions") > 0), seen.where(F.size("mentions") == 0)
    each = some.select("row", "names", F.posexplode("mentions").alias("at", "mention"))
    word = F.lower("mention")
    each = each.withColumn("kind", F.when(F.array_contains(known, word), "name").otherwise(kind_of(F.col("mention"))))
    gender = F.array_min(F.transform(F.filter("names", lambda n: n["word"] == word), lambda n: n["gender"]))
    each = each.select("row", "at", "mention", "kind", F.coalesce(gender, F.lit("unknown")).alias("gender")).distinct()
    each = staged(each.withColumn("entity", entity_of(F.col("kind"), F.col("mention"))), "each")
    shown = lambda g: F.count(F.when(F.col("gender") == g, 1))
    most = F.when(shown("male") > shown("female"), "male").when(shown("female") > 0, "female").otherwise("unknown")
    map_ = assign(each.groupBy("kind", "entity").agg(most.alias("gender")), key)
    worn = each.join(map_, ["kind", "entity"]).select("row", F.struct("at", dressed(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("new"), "kind").alias("m"))
    worn = worn.groupBy("row").agg(F.array_sort(F.collect_list("m")).alias("worn"))
    put = F.concat(F.array_join(F.transform(F.arrays_zip(F.slice("between", 1, F.size("worn")).alias("b"), F.col("worn").alias("w")), lambda x: F.concat(x["b"], x["w"]["new"])), ""), F.element_at("between", -1))
    follows = lambda w, i: (w["kind"] == "name") & (F.get("worn", i - 1)["kind"] == "name") & F.rlike(F.get("between", i), F.lit("^[ -]$"))
    mentions = F.size("worn") - F.size(F.filter("worn", follows))
    done = some.join(worn, "row").select("id", put.alias("text"), mentions.alias("n_mentions"), F.array_sort(F.array_distinct(F.transform("worn", lambda w: w["kind"]))).alias("kinds"))
    return none(rows.where(~hint), F.col("text")).unionByName(none(plain, F.element_at("between", 1))).unionByName(done).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_mentions", "kinds")


def op4_surrogate_pii(spark, sf_dir: str) -> DataFrame:
    return surrogates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
