"""PII: detected entities get keyed surrogates of their own type and format.

Types: e-mail addresses, IPv4 and IPv6 addresses, payment card numbers (13 to 19 digits that pass the Luhn
check, in one piece or in groups of 4-4-4-n or 4-6-5), bank accounts (IBAN that pass their check), social security
numbers as written in the USA, telephone numbers with country code or area code (see PHONE), secrets of 32 to 64
hexadecimal digits, access tokens with a known prefix, and names after a title. A surrogate keeps length, letter case, digit
places and punctuation (but for short IPv6 addresses whose form is used up); cards pass the Luhn check and keep the first digit; accounts keep the country and pass
their check; names keep the gender that the title tells, the number of parts and the script (Latin, Greek or Cyrillic).
Not detected: names without a title, postal addresses, numbers in other forms than those.

Coreference: one normalised entity has one surrogate in all documents, since it is a keyed hash
of type and value. Distinctness: surrogates are compared over the whole corpus with each other
and with all detected values; whoever loses a collision is drawn again with the next counter.
The last word on ties is the smallest value, so results don't depend on the order of rows. Where values of a
format run out, which takes most of its space, assign() raises ValueError after MAX_TURNS draws.

Only documents that have entities take part in joins; the others pass through the scan.
Entities of hot documents or hot values meet in shuffled joins, which Spark splits where skewed.

Defined results: null texts stay null, texts without entities stay as they are, repeated rows
stay repeated, other columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, text

# Titles by the gender they tell; m, f or n (none).
TITLES = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Sir": "m", "Κύριος": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Κυρία": "f", "Госпожа": "f",
    "Dr": "n", "Prof": "n",
}
# Given names by script and gender.
GIVEN = {
    "latin-m": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Oscar", "Paul", "Simon", "Victor"],
    "latin-f": ["Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Helena", "Irene", "Julia", "Karla", "Laura", "Maria", "Nina", "Olga", "Paula", "Vera"],
    "latin-n": ["Alex", "Andrea", "Chris", "Dominique", "Eden", "Jamie", "Jordan", "Kim", "Logan", "Morgan", "Noa", "Robin", "Sacha", "Sam", "Taylor", "Toni"],
    "greek-m": ["Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος"],
    "greek-f": ["Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"],
    "greek-n": ["Φοίβη", "Χρύσα", "Ανέστη", "Θέμις", "Ραλλού", "Στάθη", "Ερμή", "Νίκη"],
    "cyrillic-m": ["Антон", "Борис", "Виктор", "Денис", "Иван", "Максим", "Олег", "Павел"],
    "cyrillic-f": ["Анна", "Вера", "Галина", "Дарья", "Ирина", "Мария", "Нина", "Ольга"],
    "cyrillic-n": ["Женя", "Саша", "Валя", "Слава", "Шура", "Паша", "Тоня", "Лёня"],
}
# Syllables of surnames by script, 16 each, one for a hexadecimal digit.
SYLLABLES = {
    "latin": ["ba", "del", "fi", "gor", "han", "jo", "kel", "lin", "mar", "no", "pel", "rin", "sto", "tur", "van", "wes"],
    "greek": ["βα", "δελ", "φι", "γορ", "καν", "λι", "μαρ", "νο", "πελ", "ριν", "στο", "του", "θαν", "ξεν", "ζω", "ψα"],
    "cyrillic": ["ба", "дел", "фи", "гор", "кан", "ли", "мар", "но", "пел", "рин", "сто", "тур", "ван", "жел", "зо", "ша"],
}

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,254}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
# With country code: 7 digits or more, in groups of up to four after the code. With area code: as written in
# North America, with the trunk zero of France and Germany, or nine digits from 6 to 9 as in Spain.
PLUS_PHONE = (
    r"\+(?=(?:[ .()/\-]{0,3}\d){7})\d{1,3}[ .\-]?\(?\d{1,4}\)?(?: ?/ ?\d{1,4}|[ .\-]?\d{1,4}){2,5}(?!\d)"
    r"|\+(?=(?:[ .()/\-]{0,3}\d){7})\d{1,3}[ .\-]?\(\d{1,4}\) ?\d{1,4}(?:(?: ?/ ?|[ .\-])\d{2,8}){1,5}(?!\d)"
    r"|\+\d{1,3}[ .\-]\(?\d{1,4}\)?(?: ?/ ?|[ .\-])\d{5,8}(?:[ .\-]\d{1,4})?(?!\d)"
)
PHONE = PLUS_PHONE + (
    r"|(?<![\d\w])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)"
    r"|(?<![\w.+\-/])(?:1[ .\-])?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\w\-/]|\.\d)"
    r"|(?<![\w.+\-/])0[1-9](?:(?: \d\d){4}|(?:\.\d\d){4}|(?:-\d\d){4}|\d{8})(?![\w\-/]|\.\d)"
    r"|(?<![\w.+\-/])(?=\(?(?:[ ()/\-]{0,3}\d){8})(?:\(0[1-9]\d{1,4}\) ?|0[1-9]\d{1,4}(?: ?/ ?|[ \-]))\d{2,8}(?:[ \-]\d{2,4}){0,3}(?![\w\-/]|\.\d)"
    r"|(?<![\w.+\-/]|\d[ ,])[6-9]\d(?:\d[ \-]\d{3}[ \-]\d{3}|\d[ \-]\d\d[ \-]\d\d[ \-]\d\d|[ \-]\d{3}[ \-]\d\d[ \-]\d\d)(?![\w\-/]|[.,]\d| \d)"
)
CARD = r"(?<![\w.])(?:\d{4}[ \-]){3}\d{1,7}(?![\w])|(?<![\w.])\d{4}[ \-]\d{6}[ \-]\d{5}(?![\w])|(?<![\w.])\d{13,19}(?![\w])"
IPV6 = (
    r"(?<![\w:.])(?=[0-9A-Fa-f:]{0,40}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:])"
)
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
# Prefixes by which access tokens are known.
TOKEN = r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|sk-[A-Za-z0-9_\-]{20,255})(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])"
NAME = r"(?<![\p{L}])(?:" + "|".join(TITLES) + r")\.? \p{Lu}[\p{L}'\-]{1,31}(?: \p{Lu}[\p{L}'\-]{1,31}){0,2}"
# Most begin where a word does; looking there first spares the others a try at every letter.
ENTITY = f"(?<![A-Za-z0-9])(?:{EMAIL}|{IPV4}|{TOKEN}|{SECRET}|{SSN}|{PHONE}|{CARD}|{IBAN}|{IPV6}|{NAME})|{IPV4}|{PLUS_PHONE}|{NAME}"
MAX_TURNS = 60
# What ENTITY matches, MAY_HAVE matches.
FIRST_OF_TITLES = "".join(sorted({t[0] for t in TITLES}))
MAY_HAVE = "[@0-9]|AKIA|ASIA|gh[pousr]_|sk-|[a-f]{32}|[A-F]{32}|(?=[" + FIRST_OF_TITLES + "])(?:" + "|".join(TITLES) + r")\.? \p{Lu}"


def _luhn_sum(digits: Column) -> Column:
    """Of an array of digits, the last of them undoubled."""
    n = F.size(digits)

    def worth(d: Column, i: Column) -> Column:
        v = d.cast("int")
        return F.when((n - i) % 2 == 0, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, x: a + x)


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _kind(v: Column) -> Column:
    digits = F.regexp_replace(v, r"\D+", "")
    luhn = let(_chars(digits), lambda d: _luhn_sum(d) % 10 == 0)
    return (
        F.when(v.contains("@"), "email")
        .when(v.rlike(f"^(?:{IPV4})$"), "ip")
        .when(v.rlike(r"^[0-9a-f]{32,64}$|^[0-9A-F]{32,64}$"), "secret")
        .when(v.rlike(f"^(?:{SSN})$"), "ssn")
        .when(v.rlike(f"^(?:{PHONE})$"), "phone")
        .when(v.rlike(f"^(?:{TOKEN})$"), "token")
        .when(v.rlike(f"^(?:{IPV6})$"), "ip6")
        .when(v.rlike(f"^(?:{IBAN})$"), F.when(let(_compact(v), lambda x: F.length(x).between(15, 34) & (_mod97(x) == 1)), "iban"))
        .when(v.rlike(r"^\d"), F.when(F.length(digits).between(13, 19) & luhn, "card"))
        .otherwise("name")
    )


def _compact(v: Column) -> Column:
    return F.replace(v, F.lit(" "), F.lit(""))


def _mod97(account: Column) -> Column:
    """The rest by 97 of an account number: its first four characters go last, letters count 10 to 35."""
    moved = _chars(F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4)))
    return F.aggregate(moved, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _normal(kind: Column, v: Column) -> Column:
    """E-mail addresses, IPv6 addresses and secrets are compared without case, numbers by their digits, accounts without blanks."""
    return F.when(kind.isin("email", "secret", "ip6"), F.lower(v)).when(kind == "iban", _compact(v)).when(kind.isin("phone", "card"), F.regexp_replace(v, r"[ .()/\-]+", "")).otherwise(v)


def _shaped(v: Column, h: Column) -> Column:
    """v with each letter and digit replaced by the hash, at its place; hexadecimal digits h are 128."""
    digits, low = F.translate(h, "abcdef", "024681"), F.translate(h, "0123456789abcdef", "bcdfghjklmnpqrst")
    at = lambda s, i: F.substring(s, i % 128 + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9]"), at(digits, i)).when(c.rlike("[a-z]"), at(low, i)).when(c.rlike("[A-Z]"), F.upper(at(low, i))).otherwise(c)

    return F.array_join(F.transform(_chars(v), one), "")


def _surrogate(kind: Column, v: Column, h: Column, turn: int) -> Column:
    """For the normalised value v and 128 hexadecimal digits h. Later turns draw from wider spaces."""
    number = lambda start, n: F.conv(F.substring(h, start, 4), 16, 10).cast("int") % n
    email = F.concat(_shaped(F.substring_index(v, "@", 1), h), F.lit("@"), F.substring(F.translate(F.substring(h, 100, 12), "0123456789", "ghijklmnop"), 1, 8), F.lit(".example"))
    ip = F.concat_ws(".", F.lit("10") if turn < 3 else (number(20, 223) + 1).cast("string"), *[number(s, 256).cast("string") for s in (1, 5, 9)])
    hexes = F.substring(h, F.lit(1), F.length(v))
    body = F.concat(F.substring(v, 1, 1), F.substring(F.translate(h, "abcdef", "024681"), F.lit(2), F.length(v) - 2))
    card = F.concat(body, ((10 - let(_chars(F.concat(body, F.lit("0"))), _luhn_sum) % 10) % 10).cast("string"))
    fixed = 2 if turn < 8 else 1
    phone = F.concat(F.substring(v, 1, fixed), F.substring(_shaped(v, h), F.lit(fixed + 1), F.length(v)))
    ip6 = F.array_join(F.transform(_chars(v), lambda c, i: F.when(c == ":", c).otherwise(F.substring(h, i + 1, F.lit(1)))), "")
    if turn > 2:  # short forms such as ::1 have few others
        ip6 = F.concat_ws(":", F.lit("fd00"), *[F.substring(h, 4 * k + 1, 4) for k in range(7)])
    prefix = F.regexp_extract(v, "^(?:AKIA|ASIA|gh._|sk-)", 0)
    token = F.concat(prefix, F.substring(_shaped(v, h), F.length(prefix) + 1, F.length(v)))
    bare = F.concat(F.substring(v, 1, 2), F.lit("00"), F.substring(_shaped(v, h), F.lit(5), F.length(v)))
    iban = let(bare, lambda b: F.concat(F.substring(b, 1, 2), F.lpad((98 - _mod97(b)).cast("string"), 2, "0"), F.substring(b, F.lit(5), F.length(b))))
    title = F.rtrim(F.regexp_extract(v, r"^(\S+?\.?) ", 1))
    sex = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv]), F.regexp_replace(title, r"\.$", "")), F.lit("n"))
    parts = F.slice(F.split(v, " "), 2, 8)
    script = F.when(F.element_at(parts, 1).rlike(r"^\p{IsGreek}"), "greek").when(F.element_at(parts, 1).rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    given = F.create_map(*[x for k, names in GIVEN.items() for x in (F.lit(k), F.array(*map(F.lit, names)))])
    parts_of = F.create_map(*[x for k, s in SYLLABLES.items() for x in (F.lit(k), F.array(*map(F.lit, s)))])
    first = let(F.element_at(given, F.concat_ws("-", script, sex)), lambda g: F.element_at(g, F.pmod(number(1, 65536), F.size(g)) + 1))
    last = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4 + min(turn, 50))), lambda k: F.element_at(F.element_at(parts_of, script), (F.conv(F.substring(h, k + 10, F.lit(1)), 16, 10).cast("int") + 1))), ""))
    middle = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda k: F.element_at(F.element_at(parts_of, script), (F.conv(F.substring(h, k + 20, F.lit(1)), 16, 10).cast("int") + 1))), ""))
    name = F.when(F.size(parts) == 1, F.concat_ws(" ", title, last)).when(F.size(parts) == 2, F.concat_ws(" ", title, first, last)).otherwise(F.concat_ws(" ", title, first, middle, last))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "secret", hexes).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", _shaped(v, h)).when(kind == "token", token).when(kind == "ip6", ip6).when(kind == "iban", iban).otherwise(name)


def _dressed(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate of the normalised value in the punctuation and case of the raw one."""
    digits = F.when(kind == "iban", surrogate).otherwise(F.regexp_replace(surrogate, r"\D+", ""))

    def numbered(chars: Column) -> Column:
        isnum = lambda c: F.when(c.rlike("[0-9A-Z]"), 1).otherwise(0)
        steps = F.transform(chars, lambda c, i: F.when(c.rlike("[0-9A-Z]"), F.substring(digits, F.aggregate(F.slice(chars, F.lit(1), i + 1), F.lit(0), lambda a, x: a + isnum(x)), F.lit(1))).otherwise(c))
        return F.array_join(steps, "")

    cased = F.when((raw == F.upper(raw)) & raw.rlike("[A-Z]"), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "iban"), let(_chars(raw), numbered)).when(kind.isin("secret", "ip6"), cased).otherwise(surrogate)


def entities(docs: DataFrame) -> DataFrame:
    """kind, value: the distinct normalised entities of docs."""
    found = docs.where(F.col("text").rlike(MAY_HAVE)).select(F.explode(F.regexp_extract_all(text(), F.lit(f"({ENTITY})"), 1)).alias("raw"))
    found = found.groupBy("raw").count().withColumn("kind", _kind(F.col("raw"))).where("kind is not null")
    return found.groupBy("kind", _normal(F.col("kind"), F.col("raw")).alias("value")).agg(F.sum("count").alias("n"))


def assign(found: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate: distinct surrogates that are no detected value."""
    todo = found.select("kind", "value")
    done, turn = None, 0
    while True:
        h = F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "value", F.lit(f"{turn}:{k}")), 256) for k in (0, 1)])
        drawn = todo.withColumn("surrogate", _surrogate(F.col("kind"), F.col("value"), h, turn))
        best = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("_first"))
        taken = found.select("kind", F.col("value").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        best = best.join(taken, ["kind", "surrogate"], "left_anti").withColumnRenamed("_first", "value")
        won = cut(best.select("kind", "value", "surrogate"), "surrogates")
        done = won if done is None else done.unionByName(won)
        rest = cut(todo.join(won, ["kind", "value"], "left_anti"), "collided")
        if rest.isEmpty():
            return done
        if turn == MAX_TURNS:
            raise ValueError("no surrogates left for some values: their formats are used up")
        todo, turn = rest, turn + 1


def replace(docs: DataFrame, key: str) -> DataFrame:
    """docs with every detected entity in text replaced; adds n_entities. Whoever has the key can draw the same surrogates."""
    if not key:
        raise ValueError("surrogates need a key")
    raws = F.regexp_extract_all(text(), F.lit(f"({ENTITY})"), 1)
    kinds = assign(cut(entities(docs), "entities"), key)
    may = F.coalesce(F.col("text").rlike(MAY_HAVE), F.lit(False))
    row = F.struct(F.col("doc_id").alias("i"), F.xxhash64(text()).alias("h"))
    spots = (
        docs.where(may).select(row.alias("_key"), raws.alias("_raw")).where(F.size("_raw") > 0).dropDuplicates(["_key"])
        .select("_key", F.posexplode("_raw").alias("at", "raw")).withColumn("kind", _kind(F.col("raw"))).withColumn("value", _normal(F.col("kind"), F.col("raw")))
    )
    named = spots.join(kinds, ["kind", "value"], "left").withColumn("new", F.when(F.col("surrogate").isNotNull(), _dressed(F.col("kind"), F.col("raw"), F.col("surrogate"))).otherwise(F.col("raw")))
    per_doc = named.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("_new"), F.count("surrogate").alias("_n")).where("_n > 0")
    hit = docs.where(may).withColumn("_k", row)
    pieces = F.split(text(), ENTITY, -1)
    rebuilt = let(pieces, lambda p: F.array_join(F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.get("_new", i)["new"], F.lit("")))), ""))
    hit = hit.join(per_doc, hit["_k"].eqNullSafe(per_doc["_key"]), "left").withColumn("text", F.when(F.col("_n").isNotNull(), rebuilt).otherwise(F.col("text")))
    hit = hit.withColumn("n_entities", F.coalesce("_n", F.lit(0).cast("long"))).drop("_k", "_key", "_new", "_n")
    return hit.unionByName(docs.where(~may).withColumn("n_entities", F.lit(0).cast("long")))
