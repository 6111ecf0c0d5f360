"""Surrogates for personal data: keyed, type-consistent and distinct, by DataFrame functions only.

One pattern finds e-mail and IP addresses, IBANs, social security, card and phone numbers, credentials,
and names behind a title. What is found becomes an entity in a form that does not depend on how it is
written (small letters, digits only), so that all its mentions, in all documents, get one surrogate. The
surrogate is drawn from a keyed hash: letters and digits change place by place and keep their kind, a card
keeps its issuer digit and whether its check digit is right, an IBAN its country and a right check number, an IP
address the number of digits of each part. A name is replaced word by word, given names by names of the same
gender and script, family names by names of the same script; a family name alone refers to the same person. In a
document with a titled name its parts are also replaced where they stand without title, as whole capitalised words.

Draws are checked: a surrogate that is drawn for two entities, or that is itself an entity of the corpus, is
kept by the first at most and drawn again for the others, until all differ. Names of several parts come in
when single names run out; a form that has no room for another draw grows.

Nulls and texts without a find stay as they are. Rows that repeat both doc_id and text are handled alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import free_name, stored

MALE = "Mr Mister Herr Herrn Monsieur Sr Señor Don Sir Г-н Господин Κύριος Κος".split()
FEMALE = "Mrs Ms Miss Frau Mme Mlle Madame Mademoiselle Sra Srta Señora Señorita Doña Г-жа Госпожа Κυρία Κα".split()
EITHER = "Dr Prof Dra Доктор Профессор".split()
NAMES = {
    ("given", "m", "latin"): "Adrian Bruno Conrad Damian Edgar Felix Gideon Hugo Ivor Jasper Leander Marius Norbert Oscar Quentin Rufus".split(),
    ("given", "f", "latin"): "Adela Beatrix Clara Delia Edith Flora Greta Helena Ida Judith Leonie Mabel Nadine Odette Paula Rosalind".split(),
    ("given", "x", "latin"): "Alexis Robin Kim Sascha Dominique Andrea Noel Quinn Jules Marlowe Sidney Rowan".split(),
    ("family", "x", "latin"): "Ashdown Brandt Carver Delorme Elster Farrow Granger Holm Ibarra Jansen Keller Lorca Merrick Novak Ortega Prentice Quill Rousseau Sander Thorne Ulrich Verne Winslow Ziegler".split(),
    ("given", "m", "cyrillic"): "Аркадий Борис Вадим Глеб Денис Егор Захар Игнат Лев Макар".split(),
    ("given", "f", "cyrillic"): "Алла Вера Галина Дарья Жанна Зоя Инна Лидия Майя Нина".split(),
    ("given", "x", "cyrillic"): "Саша Женя Валя Шура Слава".split(),
    ("family", "x", "cyrillic"): "Беленко Гринько Дьяченко Жук Загорный Ищук Коваль Лысенко Мороз Остапенко".split(),
    ("given", "m", "greek"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θανάσης".split(),
    ("given", "f", "greek"): "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή".split(),
    ("given", "x", "greek"): "Άγγελος Αναστάσιος Χαρίτος".split(),
    ("family", "x", "greek"): "Αλεξίου Βλάχος Γαλάνης Δούκας Ζήσης Κόκκινος".split(),
}
_TITLES = "|".join(sorted(MALE + FEMALE + EITHER, key=len, reverse=True))
_TITLE = rf"(?:{_TITLES})\.?\s"
#: What stands behind a word that may be a title, and is no name.
NOT_NAMES = (
    "Administrator Analyst Architect Associate Consultant Data Designer Developer Director Engineer Executive Lead Manager Officer Product Project Sales Scientist "
    "Software Specialist Technician America Earth International Quijote Quixote Universe World"
).split()
_NAME = rf"(?!(?:{'|'.join(NOT_NAMES)})(?!\p{{L}}))\p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+){{0,2}}"
#: What announces a telephone number, which may then be written in any way.
_CALL = r"(?i:tel|telephone|telefon|telefono|teléfono|tél|phone|mobile|mobil|cell|fax)(?: ?(?:no|nr))?\.?[:=]?[ \t]{0,3}"
_LABEL = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
#: Kinds in the order in which they are tried. All start where no letter or digit stands before.
KINDS = {
    "email": r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "key": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}+",
    "secret": rf"{_LABEL}(?=[^\s\"'=:,;]*[\p{{L}}\p{{N}}])[^\s\"'=:,;]{{6,}}+",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "ssn": r"(?<!\d-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d[.-])[2-6](?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\d-])"
    # with a country code, in any groups
    r"|\+(?=(?:[ ().-]{0,2}\d){8,15}(?!\d))\d++(?:[ .-]?+(?:\(\d{1,4}\)|\d++)){0,8}+"
    rf"|{_CALL}(?=[(]?(?:[ ()./-]{{0,2}}\d){{7,15}}(?!\d))(?:\(\d{{1,5}}\)|\d++)(?:[ ./-]?+\d++){{0,6}}+",
    "name": _TITLE + _NAME,
}
PATTERN = r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}+(._%-])(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
#: A capitalised word, which may be a name of the document that stands without title.
WORD = r"(?<![\p{L}\p{N}])\p{Lu}\p{L}+(?:['’-]\p{L}+)*"
#: A text without any of these holds none of the kinds.
MAY = rf"[0-9@=:]|AKIA|ASIA|gh[pousr]_|(?=[{''.join(sorted({t[0] for t in MALE + FEMALE + EITHER}))}])(?:{_TITLES})\.?\s"
#: Failed draws after which an IP address may have parts of other lengths, and any form grows.
FREE, WIDER = 3, 6
DIGITS = ("ssn", "card", "phone")


def _join_key(docs: DataFrame, text: str) -> Column:
    return F.struct(F.xxhash64("doc_id", text).alias("a"), F.xxhash64(F.lit(7), text, "doc_id").alias("b"))


def _found(text: Column) -> Column:
    """The matches in order: kind, what stands before the value (a label or title), and the value."""

    def one(m: Column) -> Column:
        kind = F.coalesce(*[F.when(m.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in KINDS.items()])
        before = F.when(kind == "name", F.regexp_extract(m, f"^({_TITLE}){_NAME}$", 1)).when(kind == "secret", F.regexp_extract(m, f"^({_LABEL})", 1)).when(kind == "phone", F.regexp_extract(m, f"^({_CALL})", 1)).otherwise("")
        return F.struct(kind.alias("kind"), before.alias("before"), F.substring(m, F.length(before) + 1, F.length(m)).alias("value"))

    return F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), one)


def _hash(seed: Column, n: Column) -> Column:
    """A whole number below 2 to the 32 from a seed and a place."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", seed, n.cast("string")), 256), 1, 8), 16, 10).cast("long")


def _letter(first: str, n: Column, size: int) -> Column:
    return F.char(F.lit(ord(first)) + F.pmod(n, F.lit(size)))


def _scrambled(text: Column, seed: Column, kept: Column) -> Column:
    """Each letter and digit from place `kept` on drawn anew within its kind; the rest as it is.

    A hexadecimal string stays one. The first digit stays other than zero.
    """
    hexadecimal = text.rlike("^[0-9a-f]+$")

    def one(c: Column, i: Column) -> Column:
        n = _hash(seed, i)
        digit = F.when((i == 0) & (c != "0"), F.pmod(n, F.lit(9)) + 1).otherwise(F.pmod(n, F.lit(10))).cast("string")
        small = F.when(hexadecimal, _letter("a", n, 6)).otherwise(_letter("a", n, 26))
        drawn = F.when(c.rlike("[0-9]"), digit).when(c.rlike("[A-Z]"), _letter("A", n, 26)).when(c.rlike("[a-z]"), small)
        # letters outside ASCII move within their block of 16
        other = F.when(c.rlike(r"\p{Ll}") & ~c.rlike("[a-z]"), _letter("a", n, 26)).when(c.rlike(r"\p{Lu}"), _letter("A", n, 26))
        return F.when(i < kept, c).otherwise(F.coalesce(drawn, other, c))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The sum whose last digit is zero for a right card number."""
    n = F.length(digits)

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(F.pmod(n - i, F.lit(2)) == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda a, x: a + x)


def _card(canon: Column, seed: Column) -> Column:
    body = F.substring(_scrambled(canon, seed, F.lit(1)), 1, 18)
    body = F.left(body, F.length(canon) - 1)
    wanted = F.pmod(_luhn(canon), F.lit(10))
    return F.concat(body, F.pmod(wanted - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))


def _iban(canon: Column, seed: Column) -> Column:
    body = F.substring(_scrambled(canon, seed, F.lit(4)), 5, 40)
    number = F.concat(body, F.left(canon, F.lit(2)), F.lit("00"))

    def step(a: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.pmod(F.when(v > 9, a * 100 + v).otherwise(a * 10 + v), F.lit(97))

    rest = F.aggregate(F.split(number, ""), F.lit(0), step)
    return F.concat(F.left(canon, F.lit(2)), F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _ip(canon: Column, seed: Column, attempt: Column) -> Column:
    """Parts of as many digits; after some failed draws, of any number of digits."""

    def one(part: Column, i: Column) -> Column:
        n = _hash(seed, i)
        return F.when(attempt >= FREE, F.pmod(n, F.lit(223)) + 1).when(F.length(part) == 1, F.pmod(n, F.lit(9)) + 1).when(F.length(part) == 2, F.pmod(n, F.lit(90)) + 10).otherwise(F.pmod(n, F.lit(124)) + 100).cast("string")

    return F.array_join(F.transform(F.split(canon, r"\."), one), ".")


def _email(canon: Column, seed: Column, key: str) -> Column:
    """The local part by the address, the host's labels but the last by the host alone."""
    host = F.substring_index(canon, "@", -1)
    labels = F.regexp_replace(host, r"\.[^.]*$", "")
    of_host = F.sha2(F.concat_ws("|", F.lit(key), F.lit("host"), host), 256)
    return F.concat(_scrambled(F.substring_index(canon, "@", 1), seed, F.lit(0)), F.lit("@"), _scrambled(labels, of_host, F.lit(0)), F.lit("."), F.substring_index(host, ".", -1))


def _name(group: Column, seed: Column, attempt: Column) -> Column:
    """A name of the group; after each failed draw it has one more part."""
    pools = F.create_map(*[x for k, v in NAMES.items() for x in (F.lit(" ".join(k)), F.array(*map(F.lit, v)))])
    pool = F.element_at(pools, group)
    parts = F.transform(F.sequence(F.lit(0), attempt), lambda i: F.get(pool, F.pmod(_hash(seed, i), F.size(pool)).cast("int")))
    return F.array_join(parts, "-")


def draw(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canon, attempt`` with a candidate surrogate of the same form as canon."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon", F.col("attempt").cast("string")), 256)), 256)
    rows = entities.withColumn("seed", seed)
    canon, s = F.col("canon"), F.col("seed")
    kept = F.when((F.col("kind") == "phone") & (F.length(canon) == 11) & canon.startswith("1"), 1).when(F.col("kind") == "key", 4).otherwise(0)
    made = (
        F.when(F.col("kind") == "email", _email(canon, s, key))
        .when(F.col("kind") == "ip", _ip(canon, s, F.col("attempt")))
        .when(F.col("kind") == "card", _card(canon, s))
        .when(F.col("kind") == "iban", _iban(canon, s))
        .when(F.col("kind").contains(" "), F.lower(_name(F.col("kind"), s, F.col("attempt"))))
        .otherwise(_scrambled(canon, s, kept))
    )
    # a form too narrow for one more draw grows by a letter, then by two
    grown = F.transform(F.sequence(F.lit(0), F.col("attempt") - WIDER), lambda i: _letter("a", _hash(s, i), 26))
    wider = ~F.col("kind").contains(" ") & (F.col("attempt") >= WIDER)
    return rows.withColumn("surrogate", F.when(wider, F.concat(made, F.array_join(grown, ""))).otherwise(made)).drop("seed")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canon, surrogate``: distinct surrogates, none of which is an entity of its kind."""
    spark = entities.sparkSession
    whole = stored(spark, entities.select("kind", "canon").distinct(), "entities")
    taken = whole.select("kind", F.col("canon").alias("surrogate"))
    done: DataFrame | None = None
    pending = whole.withColumn("attempt", F.lit(0))
    while True:
        drawn = draw(pending, key)
        used = taken if done is None else taken.union(done.select("kind", "surrogate"))
        free = drawn.join(used, ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        won = stored(spark, won.select("kind", "canon", "surrogate"), "surrogates")
        done = won if done is None else done.union(won)
        pending = stored(spark, pending.join(won, ["kind", "canon"], "left_anti").withColumn("attempt", F.col("attempt") + 1), "pending")
        if pending.isEmpty():
            return done


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _written(kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's way of writing: its separators and its letter case."""
    # the n-th digit of the mention becomes the n-th of the surrogate
    compact = kind.isin(*DIGITS, "iban")
    place = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    # what a surrogate has grown by stands behind
    beyond = F.substring(surrogate, F.length(F.regexp_replace(value, "[^0-9A-Za-z]", "")) + 1, F.length(surrogate))
    filled = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(surrogate, place(i), F.lit(1))).otherwise(c)), "")
    filled = F.concat(filled, beyond)
    title = F.regexp_replace(F.initcap(F.regexp_replace(surrogate, "-", " ")), " ", "-")
    name = F.when((value == F.upper(value)) & (F.length(value) > 1), F.upper(surrogate)).otherwise(title)
    mail = F.when((value == F.upper(value)) & (value != F.lower(value)), F.upper(surrogate)).otherwise(surrogate)
    return F.when(compact, filled).when(kind.contains(" "), name).when(kind == "email", mail).otherwise(surrogate)


def _again(piece: Column, names: Column) -> Column:
    """A stretch of text's capitalised words: the new form of each, and whether it is a known name."""

    def one(word: Column) -> Column:
        stem = F.regexp_replace(word, "['’][sS]$", "")
        own, short = F.try_element_at(names, F.lower(word)), F.try_element_at(names, F.lower(stem))
        name = lambda value, new: _written(F.lit("family x"), value, new)
        tail = F.substring(word, F.length(stem) + 1, F.length(word))
        return F.struct(
            F.when(own.isNotNull(), name(word, own)).when(short.isNotNull(), F.concat(name(stem, short), tail)).otherwise(word).alias("new"), (own.isNotNull() | short.isNotNull()).alias("known")
        )

    return F.transform(F.regexp_extract_all(piece, F.lit(WORD), F.lit(0)), one)


def _mended(piece: Column, names: Column) -> Column:
    """The stretch with known names replaced, and how many were."""
    words = _again(piece, names)
    text = F.array_join(F.flatten(F.transform(F.split(piece, WORD, -1), lambda s, i: F.when(i == 0, F.array(s)).otherwise(F.array(F.get(words, i - 1)["new"], s)))), "")
    return F.struct(text.alias("text"), F.size(F.filter(words, lambda w: w["known"])).alias("n"))


def replace(docs: DataFrame, key: str, counts: bool = False) -> DataFrame:
    """All rows and columns, with surrogates in the texts; with counts also ``n_entities``, the number of mentions."""
    spark = docs.sparkSession
    text = next(c for c in docs.columns if c.lower() == "text")
    hit = F.coalesce(F.col(text).rlike(MAY) & F.col(text).rlike(PATTERN), F.lit(False))
    k, n = free_name(docs, "key"), free_name(docs, "n_entities")
    found, between, news, names = (free_name(docs, c) for c in ("found", "between", "news", "names"))
    hits = docs.where(hit).select(
        "*", _join_key(docs, text).alias(k), _found(F.col(text)).alias(found), F.split(F.col(text), PATTERN, -1).alias(between)
    )
    hits = stored(spark, hits, "texts-with-entities")

    each = hits.select(F.col(k).alias("key"), F.posexplode(found).alias("pos", "m")).select("key", "pos", "m.*").distinct()
    title = F.regexp_replace("before", r"[.\s]+$", "")
    parts = F.when(F.col("kind") == "name", F.split("value", " ")).otherwise(F.array("value"))
    words = each.select("*", parts.alias("parts")).select("*", F.posexplode("parts").alias("sub", "part"))
    last = F.col("sub") == F.size("parts") - 1
    gender = F.when(title.isin(MALE), "m").when(title.isin(FEMALE), "f").otherwise("x")
    role = F.when(last, F.lit("family x")).otherwise(F.concat(F.lit("given "), gender))
    kind = F.when(F.col("kind") == "name", F.concat_ws(" ", role, _script(F.col("part")))).otherwise(F.col("kind"))
    canon = (
        F.when(F.col("kind").isin(*DIGITS), F.regexp_replace("part", "[^0-9]", ""))
        .when(F.col("kind") == "iban", F.regexp_replace("part", " ", ""))
        .when(F.col("kind").isin("email", "name"), F.lower("part"))
        .otherwise(F.col("part"))
    )
    flat = stored(spark, words.select("key", "pos", "sub", "before", kind.alias("kind"), "part", canon.alias("canon")), "mentions")

    table = surrogates(flat, key)
    named = flat.join(table, ["kind", "canon"]).select("key", "pos", "sub", "before", "kind", "canon", "surrogate", _written(F.col("kind"), F.col("part"), F.col("surrogate")).alias("new"))
    per = named.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "sub", "before", "new"))).alias("news"))
    size = F.aggregate("news", F.lit(0), lambda a, x: F.greatest(a, x["pos"] + 1))

    def mention(p: Column) -> Column:
        own = F.filter("news", lambda x: x["pos"] == p)
        return F.concat(F.get(own, F.lit(0))["before"], F.array_join(F.transform(own, lambda x: x["new"]), " "))

    whole = F.transform(F.sequence(F.lit(0), size - 1), mention)
    per = per.select(F.col("key").alias(k), whole.alias("news"))
    # the parts of a document's names, as first met, are replaced wherever they stand in it
    known = named.where(F.col("kind").contains(" ")).withColumn("canon", F.regexp_replace("canon", "['’]s$", ""))
    known = known.groupBy("key", "canon").agg(F.min_by("surrogate", F.struct("pos", "sub")).alias("surrogate"))
    known = known.groupBy(F.col("key").alias(k)).agg(F.map_from_entries(F.collect_list(F.struct("canon", "surrogate"))).alias(names))
    joined = hits.join(per.withColumnRenamed("news", news), k, "left").join(known, k, "left")
    plain = F.transform(F.col(between), lambda s: F.struct(s.alias("text"), F.lit(0).alias("n")))
    joined = joined.withColumn(between, F.when(F.col(names).isNull(), plain).otherwise(F.transform(F.col(between), lambda s: _mended(s, F.col(names)))))
    rebuilt = F.array_join(F.flatten(F.transform(F.col(between), lambda s, i: F.when(i == 0, F.array(s["text"])).otherwise(F.array(F.get(F.col(news), i - 1), s["text"])))), "")
    again = F.aggregate(F.col(between), F.lit(0), lambda a, s: a + s["n"])
    changed = joined.withColumn(text, F.coalesce(rebuilt, F.col(text))).withColumn(n, (F.coalesce(F.size(news), F.lit(0)) + again).cast("long"))
    same = docs.where(~hit).withColumn(n, F.lit(0).cast("long"))
    columns = [*docs.columns, *([n] if counts else [])]
    return same.select(*columns).unionByName(changed.select(*columns))
