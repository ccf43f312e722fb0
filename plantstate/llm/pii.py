"""PII: entities are found by patterns and replaced by keyed surrogates.

A surrogate has its entity's type, script and format: digits become digits, letters
letters of the same alphabet and case, names names of the same gender; check digits of
cards and IBANs hold, the country of an IBAN or a phone stays. It is drawn from a key and
the entity's normal form only, and then written in the format of each mention, so one
entity has one surrogate in all its spellings. Persons are found by a title or a common
given name; each part of their name is an entity, and other mentions of it in the same
document are replaced too. Surrogates are checked over the whole corpus: of entities that
would share one, or whose surrogate is itself an entity, all but the first are drawn
again. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantstate.llm.common import at, blank_if_null, let, numbered, placed, rewritten, stage

#: Patterns by kind. Earlier kinds win where two would match. No repeated group can grow with the text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+(?=(?:[ .()-]{0,2}[0-9]){8})[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\)|[ .-]?[0-9]{1,4})(?:[ .-]?[0-9]{2,8}){1,5}|(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4})(?![0-9A-Za-z])",
}
NUMERIC = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Titles, and common given names, by gender.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "Κυρία")
TITLES = (*FEMALE_TITLES, "Mr", "Mx", "Dr", "Prof", "Professor", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος")
FEMALE_NAMES = (
    "Alice Anna Camille Carmen Claire Clara Elena Elizabeth Emily Emma Helen Ingrid Isabelle Jane Jennifer Jessica Julia Karen Laura Linda Lisa Lucia Margaret Maria Martha Mary "
    "Monika Nancy Nathalie Olivia Patricia Petra Rachel Sabine Sarah Sophie Susan Teresa Ursula Анна Мария Ольга Μαρία Ελένη"
).split()
MALE_NAMES = (
    "Andrew Anthony Antonio Carlos Charles Daniel David Edward François George Hans Henry Jacques James Jean John Jose José Joseph Juan Jürgen Klaus Luis Matthew Michael Michel "
    "Miguel Paul Peter Pierre Richard Robert Stefan Steven Thomas William Wolfgang Иван Дмитрий Сергей Γιώργος Νίκος"
).split()
WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{L}[\p{L}\p{M}]++)*+"
CAPITAL = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}]){WORD}"
LEAD = rf"(?:(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? )"
PERSON = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}])(?:{LEAD}{{1,3}}+{WORD}(?: {WORD})?|(?:{'|'.join(FEMALE_NAMES + MALE_NAMES)})(?: \p{{Lu}}\.)? {WORD})"
NAMES = ("given_f", "given_m", "surname")
#: Lower-case alphabets within which letters are replaced.
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "0123456789")
#: Consonants and vowels of made-up names by alphabet, and the endings of female, male and family names.
SYLLABLES = (("bdfgklmnprstvz", "aeiou", "a", "o", "en"), ("бвгдклмнпрст", "аеиоу", "а", "ов", "енко"), ("βγδκλμνπρστ", "αεηιο", "α", "ος", "ου"))
#: Telephone country codes of one and of two digits; all others have three.
CODES = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
HIT = "array<struct<start:int,end:int,kind:string,normal:string,value:string>>"


def kind_of(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in reversed(list(PATTERNS)):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def normal_form(kind: Column, value: Column) -> Column:
    """Lower-case emails and names, digits of cards, IBANs without spaces, + and digits of phones."""
    return (
        F.when(kind.isin("email", *NAMES), F.lower(value))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind == "phone", F.regexp_replace(value, "[^0-9+]", ""))
        .when(kind.isin("card", "ssn"), F.regexp_replace(value, "[^0-9]", ""))
        .otherwise(value)
    )


def name_parts(text: Column) -> Column:
    """word (lower case), kind of the parts of the persons' names in a text, sorted, each word once."""

    def parts(person: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(person, f"^{LEAD}+", ""), " "), lambda w: ~F.endswith(w, F.lit(".")))

        def one(w: Column) -> Column:
            female = person.rlike(f"^(?:{LEAD})*(?:{'|'.join(FEMALE_TITLES)})\\b") | F.get(w, F.lit(0)).isin(*FEMALE_NAMES)
            given = F.struct(F.lower(F.get(w, F.lit(0))).alias("word"), F.when(female, "given_f").otherwise("given_m").alias("kind"))
            family = F.struct(F.lower(F.element_at(w, -1)).alias("word"), F.lit("surname").alias("kind"))
            return F.when(F.size(w) > 1, F.array(given, family)).otherwise(F.array(family))

        return let(words, one)

    found = F.array_sort(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0)), parts))))
    return let(found, lambda x: F.filter(x, lambda y, i: (i == 0) | (F.get(x, i - 1)["word"] != y["word"])))


def hits(text: Column) -> Column:
    """start, end, kind, normal, value of the entities of a text, in its order. Texts without a digit, @ or
    person can't have one."""

    def search(names: Column) -> Column:
        named = F.size(names) > 0
        # Where persons are named every capital word is looked at; others than their names go.
        pattern = F.when(named, F.lit(f"{NUMERIC}|(?:{CAPITAL})")).otherwise(F.lit(NUMERIC))

        def typed(x: Column) -> Column:
            name = F.get(F.filter(names, lambda n: n["word"] == F.lower(x["value"])), F.lit(0))["kind"]
            kind = F.coalesce(F.when(named & x["value"].rlike(r"^\p{Lu}") & ~x["value"].rlike("[0-9@]"), name), kind_of(x["value"]))
            return let(kind, lambda k: F.struct(x["start"].alias("start"), x["end"].alias("end"), k.alias("kind"), normal_form(k, x["value"]).alias("normal"), x["value"].alias("value")))

        found = F.filter(F.transform(placed(text, pattern), typed), lambda x: x["kind"].isNotNull())
        return F.when(named | text.rlike("[0-9@]"), found).otherwise(F.array().cast(HIT))

    return let(name_parts(text), search)


def _numbers(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """42 keyed numbers below 4096 for an entity."""
    digits = F.concat(*[F.sha2(F.concat_ws("|", F.lit(f"{key}/{part}"), kind, normal, attempt.cast("string")), 256) for part in (0, 1)])
    return let(digits, lambda d: F.transform(F.sequence(F.lit(0), F.lit(41)), lambda i: F.conv(F.substr(d, i * 3 + 1, F.lit(3)), 16, 10).cast("int")))


def _drawn(text: Column, numbers: Column) -> Column:
    """Each lower-case or capital letter and digit of an ASCII text replaced by another of its kind."""

    def one(c: Column, i: Column) -> Column:
        n, out = F.get(numbers, i % 42), c
        for letters in (*LETTERS, LETTERS[0].upper()):
            out = F.when(F.contains(F.lit(letters), c), F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))).otherwise(out)
        return out

    return F.when(text == "", text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def luhn(digits: Column) -> Column:
    """The sum of digits, every other one doubled so that one more digit at the end isn't."""
    n = F.length(digits)
    d = lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + let(d(i), lambda x: F.when(x > 9, x - 9).otherwise(x)))


def mod97(text: Column) -> Column:
    """The remainder by 97 of a text's number, letters being 10 to 35."""

    def step(r: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(letter > 9, (r * 100 + letter) % 97).otherwise((r * 10 + c.cast("int")) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def drawn_form(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """The normal form of an entity's surrogate."""

    def made(n: Column) -> Column:
        tail = F.regexp_extract(normal, r"(\.[a-z]{2,})$", 1)
        # From the eighth attempt on an email may be longer: short ones can run out.
        more = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / 8).cast("int")), lambda i: F.when(i == 0, "").otherwise(F.substr(F.lit(LETTERS[0]), F.get(n, (i + 30) % 42) % 26 + 1, F.lit(1)))), "")
        email = F.concat(more, _drawn(F.substr(normal, F.lit(1), F.length(normal) - F.length(tail)), n), tail)
        iban = let(_drawn(F.substr(normal, F.lit(5)), n), lambda b: F.concat(F.substring(normal, 1, 2), F.lpad((98 - mod97(F.concat(b, F.substring(normal, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b))
        body = lambda s: let(_drawn(F.substring(s, 1, 15), n), lambda b: F.concat(b, ((10 - luhn(b) % 10) % 10).cast("string")))
        check = (10 - luhn(F.substring(normal, 1, 15)) % 10) % 10
        card = F.when(check.cast("string") == F.substring(normal, 16, 1), body(normal)).otherwise(_drawn(normal, n))
        head = F.regexp_extract(normal, CODES, 0)
        phone = F.concat(head, _drawn(F.substr(normal, F.length(head) + 1), n))
        ip = F.array_join(F.transform(F.slice(n, 1, 4), lambda x: (x % 254 + 1).cast("string")), ".")
        return F.when(kind == "email", email).when(kind == "iban", iban).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "ssn", _drawn(normal, n)).otherwise(_name(kind, normal, n, attempt))

    return let(_numbers(kind, normal, attempt, key), made)


def _name(kind: Column, normal: Column, numbers: Column, attempt: Column) -> Column:
    def made(syllables: tuple[str, str, str, str, str]) -> Column:
        consonants, vowels, female, male, family = syllables
        letter = lambda letters, i: F.substr(F.lit(letters), F.get(numbers, i % 42) % len(letters) + 1, F.lit(1))
        parts = F.transform(F.sequence(F.lit(0), 1 + attempt), lambda i: F.concat(letter(consonants, i * 2), letter(vowels, i * 2 + 1)))
        return F.concat(F.array_join(parts, ""), letter(consonants, F.lit(20)), F.when(kind == "given_f", female).when(kind == "given_m", male).otherwise(family))

    return F.when(normal.rlike(r"\p{IsCyrillic}"), made(SYLLABLES[1])).when(normal.rlike(r"\p{IsGreek}"), made(SYLLABLES[2])).otherwise(made(SYLLABLES[0]))


def formatted(kind: Column, value: Column, form: Column) -> Column:
    """A surrogate's normal form in the format of a mention: its case, spaces, brackets and dashes."""
    longer = F.length(form) - F.length(value)
    cased = F.zip_with(F.split(value, ""), F.split(F.substr(form, longer + 1), ""), lambda c, x: F.when(c.rlike("[A-Z]"), F.upper(x)).otherwise(x))
    email = F.concat(F.substr(form, F.lit(1), longer), F.array_join(cased, ""))
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        counts = c.rlike("[A-Z0-9+]")
        return F.struct((acc["n"] + counts.cast("int")).alias("n"), F.concat(acc["out"], F.when(counts, F.substr(form, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    spaced = F.aggregate(F.split(value, ""), start, step, lambda a: a["out"])
    name = F.when((F.length(value) > 1) & (value == F.upper(value)), F.upper(form)).otherwise(F.initcap(form))
    return F.when(kind == "email", email).when(kind == "ip", form).when(kind.isin(*NAMES), name).otherwise(spaced)


def entities(texts: DataFrame) -> DataFrame:
    """kind, normal: the distinct entities of column t."""
    found = texts.select(F.explode(F.transform(hits(F.col("t")), lambda x: F.struct(x["kind"].alias("kind"), x["normal"].alias("normal")))).alias("e"))
    return found.groupBy("e.kind", "e.normal").agg(F.lit(1).alias("one")).drop("one")


def attempts(found: DataFrame, key: str, most: int = 200) -> DataFrame:
    """kind, normal, attempt for those entities whose first surrogate collides (attempt > 0).

    A surrogate collides if another entity has it, or if it is an entity of the corpus, of
    whatever kind: a given name's surrogate is no surname of anybody. Each round draws anew for
    those that collide only, and checks them against all that are settled. Only a kind whose
    forms are nearly all taken can need more than `most` rounds; that is an error, never a
    shared surrogate."""
    todo = stage(found.select("kind", "normal", F.lit(0).alias("attempt")), "entities")
    known = todo.select(F.col("normal").alias("k_normal")).distinct()
    settled = None
    for _ in range(most):
        drawn = todo.withColumn("to", drawn_form(F.col("kind"), F.col("normal"), F.col("attempt"), key))
        taken = drawn.join(known, F.col("to") == F.col("k_normal"), "left").withColumn("bad", F.col("k_normal").isNotNull()).drop("k_normal")
        if settled is not None:
            taken = taken.join(settled.select(F.col("to").alias("s_to")), F.col("to") == F.col("s_to"), "left").withColumn("bad", F.col("bad") | F.col("s_to").isNotNull()).drop("s_to")
        place = F.row_number().over(Window.partitionBy("to").orderBy("kind", "normal"))
        now = stage(taken.withColumn("bad", F.col("bad") | (place > 1)), "drawn")
        good = now.where("not bad").select("kind", "normal", "attempt", "to")
        settled = good if settled is None else settled.unionByName(good)
        todo = now.where("bad").select("kind", "normal", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return settled.where("attempt > 0").select("kind", "normal", "attempt")
    raise ValueError(f"surrogates still collide after {most} rounds")


def replaced(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, text (with surrogates; null stays null), n_entities and found: an array of (kind, start, value, surrogate).

    start counts code points in the old text. Null and empty texts have no entities; repeated
    rows give the same text. Distinct entities of the corpus get distinct surrogates, that no
    entity of the corpus equals; spellings of one entity (case of an email, spaces of a
    phone) get one surrogate in their own format. Titles stay; a word that is a part of a
    person's name in a document is replaced wherever it stands in it as a capital word. Texts of
    any length are read whole. An empty table gives no rows."""
    d = numbered(docs)
    t = d.select(d[at(docs, id_col)].alias("key"), d[at(docs, text_col)].alias("t"), F.xxhash64(d[at(docs, id_col)], d[at(docs, text_col)]).alias("row"))
    again = stage(attempts(entities(t.select(blank_if_null(F.col("t")).alias("t"))), key), "attempts")
    collided = not again.isEmpty()
    if collided:
        held = t.select("row", F.explode(hits(blank_if_null(F.col("t")))).alias("e")).select("row", "e.kind", "e.normal").join(again, ["kind", "normal"])
        by_row = held.groupBy("row").agg(F.collect_set(F.struct("kind", "normal", "attempt")).alias("again"))
        t = t.join(by_row, "row", "left").withColumn("again", F.coalesce("again", F.array().cast("array<struct<kind:string,normal:string,attempt:int>>")))

    def drawn(e: Column) -> Column:
        tried = F.coalesce(F.get(F.filter("again", lambda a: (a["kind"] == e["kind"]) & (a["normal"] == e["normal"])), F.lit(0))["attempt"], F.lit(0)) if collided else F.lit(0)
        return F.struct(e["kind"].alias("kind"), e["normal"].alias("normal"), drawn_form(e["kind"], e["normal"], tried, key).alias("form"))

    def placed_all(found: Column, forms: Column) -> Column:
        def one(x: Column) -> Column:
            form = F.get(F.filter(forms, lambda f: (f["kind"] == x["kind"]) & (f["normal"] == x["normal"])), F.lit(0))["form"]
            return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), formatted(x["kind"], x["value"], form).alias("to"))

        return F.transform(found, one)

    # A surrogate is drawn once for each entity of a text, and then written for each mention.
    own = lambda found: F.transform(F.array_distinct(F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), x["normal"].alias("normal")))), drawn)
    t = t.withColumn("hits", let(hits(blank_if_null(F.col("t"))), lambda found: let(own(found), lambda forms: placed_all(found, forms))))
    text = F.when(F.size("hits") > 0, rewritten(F.col("t"), F.col("hits"))).otherwise(F.col("t"))
    shown = F.transform("hits", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["value"].alias("value"), x["to"].alias("surrogate")))
    return t.select("key", text.alias("text"), F.size("hits").cast("long").alias("n_entities"), shown.alias("found"))
