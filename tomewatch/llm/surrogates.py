"""Personal data replaced by keyed, type-consistent surrogates, with built-in functions only.

Mentions are found by one pattern. Each distinct entity draws a surrogate body (digits, letters or a name) from a
keyed hash; bodies that collide are drawn again until all are distinct and none is a real entity. A mention then
takes its entity's body in its own format, so an entity has one surrogate wherever and however it is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, join_hot

# Given names by gender and syllables of surnames by script.
GIVEN = {
    "latin_m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul".split(),
    "latin_f": "Anna Berta Clara Diana Emma Flora Greta Helena Ines Julia Klara Laura Maria Nina Olga Paula".split(),
    "latin_x": "Alex Robin Kim Sascha Noa Jule Toni Sam Kris Luca Mika Andrea Dominique Claude Jean Rene".split(),
    "cyrillic_m": "Антон Борис Виктор Глеб Денис Егор Игорь Кирилл".split(),
    "cyrillic_f": "Анна Вера Галина Дарья Елена Ирина Мария Ольга".split(),
    "cyrillic_x": "Саша Женя Валя Слава Никита Паша Шура Тоша".split(),
    "greek_m": "Γιώργος Νίκος Πέτρος Κώστας".split(),
    "greek_f": "Μαρία Ελένη Άννα Σοφία".split(),
    "greek_x": "Αλέξης Φώτης Χρήστος Άρης".split(),
}
SYLLABLES = {
    "latin": "ba de fi go lu ma ne pi ro su ta ve wi za ker lan".split(),
    "cyrillic": "ба де фи го лу ма не пи ро су та ве ви за кер лан".split(),
    "greek": "βα δε φι γο λου μα νε πι ρο σου τα κε λαν ζα θε χα".split(),
}
# Titles, given names that start a name without a title, and particles inside names.
# Titles in capitals that also abbreviate other things need their dot.
MALE = "(?:Mr|MR|Herr|HERR|Monsieur|MONSIEUR|Señor|SEÑOR|Sr|Don|[Гг]осподин|ГОСПОДИН|[Κκ]ύριος)"
FEMALE = r"(?:Mrs|MRS|Ms|MS\.|Miss|Frau|FRAU|Madame|MADAME|Mme|Señora|SEÑORA|Sra|Doña|[Гг]оспожа|ГОСПОЖА|[Κκ]υρία)"
TITLE = rf"(?:{MALE}|{FEMALE}|Dr|DR\.|Prof|PROF\.|Professor|PROFESSOR)"
KNOWN = {
    "m": "John James Robert Michael William Thomas Peter Hans Klaus Jürgen Wolfgang Pierre Michel François José Juan Carlos Pedro Иван Сергей Дмитрий Γιάννης Δημήτρης".split(),
    "f": "Mary Jennifer Elizabeth Susan Margaret Ana Ursula Monika Sabine Marie Catherine Isabelle Carmen Lucía Tatiana Anastasia Светлана Наталья Κατερίνα Βασιλική".split(),
}
PARTICLE = "(?:van|von|der|den|de|del|della|di|da|la|le|bin|al|ter|zu)"
# What counts as a mention, most specific first. Every repetition is bounded or of single characters without
# backtracking, and every pattern but the first letter of a name needs a boundary before it, so time is linear in the text.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}+\.){1,8}[A-Za-z]{2,24}+"
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{32,64}+|(?:AKIA|ASIA)[A-Z0-9]{16}|(?:sk|pk|ghp|gho|xoxb|xoxp)[_\-][A-Za-z0-9_\-]{16,200}+)(?![A-Za-z0-9])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{4}[ \-]?){3}[0-9]{1,7}(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{3}[.\-])[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])"
COUNTRY = r"^\+[0-9]{1,3}(?:[ .\-]|(?=\())"
WORD = r"\p{Lu}[\p{L}\p{M}]{0,39}+(?:['’\-]\p{Lu}[\p{L}\p{M}]{0,39}+){0,3}"
_FIRST = "|".join(n for names in (*GIVEN.values(), *KNOWN.values()) for n in names)
NAME = (
    rf"(?<![\p{{L}}\p{{M}}])(?=\p{{Lu}}|[гκ])(?:{TITLE}\.? (?:{PARTICLE} ){{0,2}}{WORD}(?: (?:{PARTICLE} ){{0,2}}{WORD})?"
    rf"|(?:{_FIRST})(?:-\p{{Lu}}\p{{L}}{{1,39}}+)? (?:{PARTICLE} ){{0,2}}{WORD})(?![\p{{L}}\p{{M}}])"
)
TYPES = (("email", EMAIL), ("secret", SECRET), ("ip", IP), ("ssn", SSN), ("iban", IBAN), ("card", CARD), ("phone", PHONE), ("name", NAME))
MENTION = "|".join(pattern for _, pattern in TYPES)
#: Rounds of drawing again; entities that still collide then swap among themselves.
MAX_ROUNDS = 64


def _kind(raw: Column) -> Column:
    out = None
    for name, pattern in TYPES:
        hit = raw.rlike(f"^(?:{pattern})$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("name")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def _without_country(raw: Column, kind: Column) -> Column:
    return F.when(kind == "phone", F.regexp_replace(raw, COUNTRY, "")).otherwise(raw)


def _untitled(raw: Column) -> Column:
    return F.regexp_replace(raw, rf"^{TITLE}\.? ", "")


def _parts(raw: Column, kind: Column) -> Column:
    """The entities of a mention: (class, canonical form, gender) in order. Names may have a given name and a surname."""
    words = F.filter(F.split(_untitled(raw), " "), lambda w: ~w.rlike(f"^{PARTICLE}$"))
    title = F.regexp_extract(raw, rf"^({TITLE})\.? ", 1)
    gender = F.when(title.rlike(f"^{MALE}$"), "m").when(title.rlike(f"^{FEMALE}$"), "f")
    surname = F.element_at(words, -1)
    part = lambda c, v, g: F.struct(c.alias("class"), v.alias("canon"), g.alias("gender"))
    none = F.lit(None).cast("string")
    last = part(F.concat(F.lit("surname:"), _script(surname)), F.lower(surname), none)
    given = part(F.concat(F.lit("given:"), _script(words[0])), F.lower(words[0]), gender)
    digits = _digits(_without_country(raw, kind))
    plain = (
        F.when(kind == "email", part(F.lit("email"), F.lower(raw), none))
        .when(kind == "secret", part(F.concat(F.lit("secret:"), F.length(raw).cast("string")), raw, none))
        .when(kind == "ip", part(F.lit("ip"), raw, none))
        .when(kind == "iban", part(F.concat(F.lit("iban:"), F.substring(raw, 1, 2)), F.replace(raw, F.lit(" "), F.lit("")), none))
        .otherwise(part(F.concat(kind, F.lit(":"), F.length(digits).cast("string")), digits, none))
    )
    return F.when(kind != "name", F.array(plain)).when(F.size(words) > 1, F.array(given, last)).otherwise(F.array(last))


def _stream(key: str, clas: Column, canon: Column, attempt: Column, n: Column) -> Column:
    """n numbers in 0..65535 from a keyed hash of the entity and the attempt."""
    block = lambda i: F.sha2(F.concat_ws("|", F.lit(key), clas, canon, attempt.cast("string"), i.cast("string")), 256)
    hexes = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 16).cast("int")), block), "")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(hexes, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))


def _choice(options: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), F.pmod(number, F.lit(len(options))) + 1)


def _spelt(syllables: list[str], numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda v: _choice(syllables, v)), "")


def _like(char: Column, number: Column) -> Column:
    """A character of the class of ``char`` (digit, lower, upper); others stay."""
    at = lambda letters, m: F.substring(F.lit(letters), F.pmod(number, F.lit(m)) + 1, F.lit(1))
    return (
        F.when(char.rlike("[0-9]"), at("0123456789", 10))
        .when(char.rlike("[a-z]"), at("abcdefghijklmnopqrstuvwxyz", 26))
        .when(char.rlike("[A-Z]"), at("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26))
        .otherwise(char)
    )


def _luhn(number: Column) -> Column:
    """Whether a string of digits passes the card check."""
    digits = F.transform(F.reverse(F.split(number, "")), lambda c: c.cast("int"))
    weighed = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def _iban(country: Column, account: Column) -> Column:
    """An account number of a country with its check digits, by remainders of 97 with letters as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    chars = F.split(F.concat(account, country, F.lit("00")), "")
    rest = F.aggregate(chars, F.lit(0), lambda acc, c: (acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _draw(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (class, canon, gender, attempt) with the surrogate ``body`` of each entity at its attempt."""
    clas, canon, attempt, numbers = F.col("class"), F.col("canon"), F.col("attempt"), F.col("_numbers")
    rows = rows.withColumn("_numbers", _stream(key, clas, canon, attempt, F.greatest(F.length(canon), F.lit(8))))
    chars = F.split(canon, "")
    shaped = F.array_join(F.zip_with(chars, F.slice(numbers, 1, F.size(chars)), _like), "")
    rows = rows.withColumn("_shaped", F.when(~clas.rlike("^(?:ip$|given:|surname:)"), shaped))
    body = F.col("_shaped")
    hexed = F.array_join(
        F.zip_with(chars, F.slice(numbers, 1, F.size(chars)), lambda c, v: F.when(c.rlike("[0-9a-f]"), F.lower(F.hex(v % 16))).otherwise(F.hex(v % 16))), ""
    )
    # the last digit of a card keeps its check valid or invalid, as the entity's own
    head = F.substring(body, 1, F.length(body) - 1)
    valid = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(head, d.cast("string"))), lambda s: _luhn(s) == _luhn(canon))
    card = F.element_at(valid, F.pmod(numbers[7], F.size(valid)) + 1)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    kept = F.concat(F.lit("mail."), F.lower(F.hex(numbers[2])), F.lit(".example."), F.when(domain.endswith(".net"), "net").when(domain.endswith(".org"), "org").otherwise("com"))
    email = F.concat(F.substring(body, F.lit(1), F.length(local)), F.lit("@"), kept)
    ip = F.concat_ws(".", (numbers[0] % 14 + 241).cast("string"), *[(numbers[k] % 254 + 1).cast("string") for k in (1, 2, 3)])
    out = F.when(clas == "email", email).when(clas == "ip", ip).when(clas.startswith("card:"), card)
    out = out.when(clas.startswith("iban:"), _iban(F.substring(canon, 1, 2), F.substring(body, F.lit(5), F.length(body))))
    out = out.when(clas.startswith("secret:") & canon.rlike("^[0-9a-fA-F]+$"), hexed)
    for script, parts in SYLLABLES.items():
        count = F.lit(3) + F.floor(attempt / 8).cast("int")
        spelt = lambda at, n, parts=parts: F.initcap(_spelt(parts, F.slice(numbers, at, n)))
        # a short prefix with an apostrophe and the parts of a double name keep their form
        prefix = F.initcap(F.regexp_extract(canon, r"^(\p{L}{1,2}['’])", 1))
        name = F.concat(prefix, spelt(1, F.least(count, F.lit(8))), F.when(canon.contains("-"), F.concat(F.lit("-"), spelt(3, F.lit(2)))).otherwise(""))
        out = out.when(clas == f"surname:{script}", name)
        for gender in "mfx":
            first = _choice(GIVEN[f"{script}_{gender}"], numbers[0])
            more = _spelt(parts, F.slice(numbers, 2, F.least(attempt, F.lit(6))))
            double = F.when(canon.contains("-"), F.concat(F.lit("-"), _choice(GIVEN[f"{script}_{gender}"], numbers[7]))).otherwise("")
            out = out.when((clas == f"given:{script}") & (F.col("gender") == gender), F.concat(first, more, double))
    return rows.withColumn("body", out.otherwise(body)).drop("_numbers", "_shaped")


def _genders(entities: DataFrame) -> DataFrame:
    """(class, canon, gender), one row an entity: the gender that its titles agree on, else that of a known name, else x."""
    one = entities.groupBy("class", "canon").agg(F.min("gender").alias("g"), F.max("gender").alias("g2"))
    by_name = F.lit("x")
    for gender in "mf":
        known = [n.lower() for names in (KNOWN[gender], *(v for k, v in GIVEN.items() if k.endswith(gender))) for n in names]
        by_name = F.when(F.col("canon").isin(known), gender).otherwise(by_name)
    return one.select("class", "canon", F.when(F.col("g") == F.col("g2"), F.col("g")).otherwise(by_name).alias("gender"))


def surrogate_table(entities: DataFrame, key: str, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(class, canon, body) for entities (class, canon, gender): keyed, and distinct within a class.

    An entity whose body is taken, or is itself an entity of the class, draws again with the next attempt. Of
    several that share a body the one of the smallest hash keeps it, so the result does not depend on the order.
    Entities that still collide after ``rounds`` belong to a class with nearly as many entities as its format
    has values. They swap among themselves, in groups of some thousand and with the class's entity of the smallest
    hash: each takes the next one's own value, which no other body of the class equals.
    """
    parts = max(1, int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    entities = checkpointed(_genders(entities).withColumn("attempt", F.lit(0)).repartition(parts, "class", "canon"))
    real = entities.select("class", F.lower("canon").alias("l_body")).distinct()
    table = checkpointed(_draw(entities, key))
    hashed = F.xxhash64("canon")
    for attempt in range(rounds):
        low = F.lower("body").alias("l_body")
        winner = table.groupBy("class", low).agg(F.min(F.struct("attempt", hashed.alias("h"), "canon")).alias("w"))
        judged = table.withColumn("l_body", F.lower("body")).join(winner, ["class", "l_body"])
        judged = judged.join(real.withColumn("taken", F.lit(True)), ["class", "l_body"], "left")
        again = F.col("taken").isNotNull() | (F.col("w.canon") != F.col("canon"))
        judged = checkpointed(judged.select("class", "canon", "gender", "attempt", "body", again.alias("again")))
        open_ = judged.where("again")
        if open_.isEmpty():
            return judged.select("class", "canon", "body")
        if attempt + 1 < rounds:
            drawn = _draw(open_.drop("body", "again").withColumn("attempt", F.col("attempt") + 1).repartition(parts, "class", "canon"), key)
            table = checkpointed(judged.where("not again").select(*drawn.columns).union(drawn))
    least = judged.groupBy("class").agg(F.min(F.struct(hashed.alias("h"), "canon")).alias("l"), F.count_if("again").alias("left")).where("left > 0")
    judged = judged.join(least, "class", "left")
    swaps = checkpointed(judged.withColumn("again", F.col("again") | (F.col("l.canon") == F.col("canon")) & F.col("l").isNotNull()))
    group = Window.partitionBy("class", F.pmod(hashed, F.floor(F.col("left") / 1000) + 1)).orderBy(hashed, "canon")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    swapped = swaps.where("again").select("class", "canon", F.coalesce(F.lead("canon").over(group), F.first("canon").over(whole)).alias("body"))
    return swaps.where("not again").select("class", "canon", "body").union(swapped)


def _formatted(raw: Column, kind: Column, bodies: Column) -> Column:
    """A mention with its entities' bodies in the mention's own format."""
    body = bodies[0]
    rest = _without_country(raw, kind)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    wanted = F.when(kind == "iban", F.lit("[0-9A-Z]")).otherwise(F.lit("[0-9]"))
    step = lambda acc, c: F.when(
        F.regexp_like(c, wanted), F.struct(F.concat(acc["out"], F.substring(body, acc["next"], F.lit(1))).alias("out"), (acc["next"] + 1).alias("next"))
    ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["next"].alias("next")))
    numbers = F.concat(F.regexp_extract(raw, rf"({COUNTRY})", 1), F.aggregate(F.split(rest, ""), start, step, lambda acc: acc["out"]))
    upper = F.when(raw == F.upper(raw), F.upper(body)).otherwise(body)
    title = F.regexp_extract(raw, rf"^({TITLE}\.? )", 1)
    # particles and single spaces stay; the first word that is none takes the first body, the last one the last
    words = F.split(_untitled(raw), " ")
    place = F.array_position(F.transform(words, lambda w: ~w.rlike(f"^{PARTICLE}$")), True)
    cased = lambda new, w: F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(new)).otherwise(new)
    filled = F.transform(
        words,
        lambda w, i: F.when(w.rlike(f"^{PARTICLE}$"), w).when(i + 1 == place, cased(body, w)).otherwise(cased(F.element_at(bodies, -1), w)),
    )
    named = F.concat(title, F.array_join(filled, " "))
    return F.when(kind == "email", upper).when(kind.isin("secret", "ip"), body).when(kind == "name", named).otherwise(numbers)


def _later_mentions(names: Column) -> Column:
    """The pattern of names without their titles, and of their surnames, as they may come again in a text; those in capitals also with initials alone."""
    bare = F.transform(names, _untitled)
    forms = F.concat(bare, F.transform(bare, lambda n: F.element_at(F.split(n, " "), -1)))
    capitals = F.filter(forms, lambda n: (n == F.upper(n)) & (F.length(n) > 1))
    forms = F.concat(forms, F.transform(capitals, lambda n: F.initcap(n)))
    listed = F.array_sort(F.array_distinct(forms), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.concat(F.lit(rf"({MENTION}|(?<![\p{{L}}\p{{M}}]|\p{{L}}['’\-])(?=\p{{L}})(?:"), F.array_join(listed, "|"), F.lit(r")(?![\p{L}\p{M}]|['’\-]\p{Lu}))"))


def replace_personal_data(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its text's personal data replaced: id, text, n_mentions, n_entities and types.

    Found are e-mail and IP addresses, secrets (hexadecimal strings of 32 digits and more, known key prefixes),
    payment card, social security and bank account (IBAN) numbers, phone numbers, and names: words with capitals (also
    inside, with hyphens, apostrophes and particles) after a title, or a surname after one of some hundred given
    names; and in the same text those names again without their title, and their surnames alone (after a name in
    capitals also with an initial alone, but not the other way round). Names without any such
    sign, birth dates and postal addresses are not found. A local part of an address above 64 characters is none.

    Replacements are fixed by ``key`` and the entity, so they agree across documents and runs. They keep the type and
    the format: length, digit groups, separators, country codes, letter case, a card's check digit valid or not, valid
    account check digits, a name's title, particles, double form, gender and script. Two entities of a class never
    share a surrogate, and no surrogate of a class is a real entity of it (but in a class that has nearly as many
    entities as its format has values, see ``surrogate_table``). Equal entities written differently (spaces in a card
    number, case of an address, a phone number with and without country code, a title before a name) keep one surrogate.

    Texts are read once to gather mentions and once to be rebuilt, for which alone they are shuffled; a mention's
    replacement comes by a join on the distinct mention, in which mentions that many documents hold are joined
    apart. Patterns take linear time. Only built-in functions run.

    A null text stays null and an empty one empty, both without mentions. Rows without mentions come back
    unchanged. Null ids are handled like any id; rows of one id are rebuilt each from its own text. Other
    columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.xxhash64(text_col).alias("_h"))
    is_name = lambda r: r.rlike(f"^(?:{TITLE}[. ]|(?:{_FIRST})[ -])") & ~r.contains("@")
    # later mentions are found in the same pass, so texts are joined and shuffled only to be rebuilt
    found = texts.withColumn("_raws", F.regexp_extract_all("_text", F.lit(f"({MENTION})"), F.lit(1))).where(F.size("_raws") > 0)
    found = found.withColumn("names", F.array_distinct(F.filter("_raws", is_name)))
    found = found.withColumn("_pattern", F.when(F.size("names") > 0, _later_mentions(F.col("names"))))
    raws = F.when(F.size("names") > 0, F.regexp_extract_all("_text", F.col("_pattern"), F.lit(1))).otherwise(F.col("_raws"))
    seen = checkpointed(found.select("_id", "_h", "names", raws.alias("raws")).dropDuplicates(["_id", "_h"]))
    named = seen.where(F.size("names") > 0).select("_id", "_h", "names")
    keys = lambda df: df.withColumnRenamed("_id", "_key").withColumnRenamed("_h", "_key_h")
    same = F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_key_h"))
    listed = checkpointed(seen.select("_id", "_h", F.posexplode("raws").alias("pos", "raw")))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    mentions = listed.select("raw").distinct().repartition(parts, "raw").withColumn("kind", _kind(F.col("raw")))
    split = checkpointed(mentions.select("raw", "kind", F.posexplode(_parts(F.col("raw"), F.col("kind")))).select("raw", "kind", "pos", "col.*"))
    table = surrogate_table(split.select("class", "canon", "gender"), key)
    bodies = (
        split.join(table, ["class", "canon"])
        .groupBy("raw", "kind")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda s: s["body"]).alias("bodies"),
            F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "class", "canon"))), "|").alias("entity"),
        )
    )
    new = bodies.select("raw", "kind", F.xxhash64("entity").alias("e"), _formatted(F.col("raw"), F.col("kind"), F.col("bodies")).alias("new"))
    filled = join_hot(listed, checkpointed(new), "raw")
    per_doc = filled.groupBy("_id", "_h").agg(F.array_sort(F.collect_list(F.struct("pos", "new", "e", "kind"))).alias("_hits"))
    per_doc = per_doc.join(keys(named), same, "left").drop("_key", "_key_h")
    between = F.when(F.size("names") > 0, F.split("_text", _later_mentions(F.col("names")), -1)).otherwise(F.split("_text", MENTION, -1))
    joined = texts.join(keys(per_doc), same, "left")
    hits, n = F.col("_hits"), F.coalesce(F.size("_hits"), F.lit(0))
    has = hits.isNotNull()
    joined = joined.withColumn("_between", F.when(has, between))
    rebuilt = F.concat(
        F.array_join(F.zip_with(F.slice("_between", F.lit(1), F.size("_hits")), "_hits", lambda a, b: F.concat(a, b["new"])), ""), F.element_at("_between", -1)
    )
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(has, rebuilt).otherwise(F.col("_text")).alias("text"),
        F.when(has, n).otherwise(0).alias("n_mentions"),
        F.when(has, F.size(F.array_distinct(F.transform("_hits", lambda m: m["e"])))).otherwise(0).alias("n_entities"),
        F.when(has, F.array_sort(F.array_distinct(F.transform("_hits", lambda m: m["kind"])))).otherwise(F.array().cast("array<string>")).alias("types"),
    )
