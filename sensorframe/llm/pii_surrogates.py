"""Personal data replaced by surrogates of the same type and format, in DataFrame expressions only.

A surrogate depends on a key and on the entity alone, so an entity has the same surrogate wherever it stands
(coreference), however it is written: numbers are compared by their digits, addresses and names in lower case. A given name
after a title without gender (Dr.) is the same as after one with, if the texts have it with one gender only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.textscan import free_name
from sensorframe.session import materialize

#: Patterns of the kinds, in Java's syntax, in the order in which they are tried.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\p{L}\p{N}])"
PHONE = (
    r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{L}\p{N}-])"
)
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
CARD = r"(?<![\p{L}\p{N}])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?![\p{L}\p{N}])"
IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)(?!\.?[\p{L}\p{N}])"
FEMALE = r"Mrs\.?|Ms\.?|Miss|Frau|Señora|Señorita|Sra\.|Madame|Mademoiselle|Mme\.?|Mlle\.?|Госпожа|Κυρία"
MALE = r"Mr\.?|Herr|Señor|Sr\.|Monsieur|Господин|Κύριος"
OTHER = r"Dr\.|Prof\."
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{FEMALE}|{MALE}|{OTHER}) +\p{{Lu}}\p{{Ll}}+(?:-\p{{Lu}}\p{{Ll}}+)?(?: \p{{Lu}}\p{{Ll}}+(?:-\p{{Lu}}\p{{Ll}}+)?)?"
PATTERN = "|".join([EMAIL, IBAN, PHONE, SSN, CARD, IP, NAME])

#: Any match holds a digit, an @ or a title; texts without are not searched further.
HINT = rf"[0-9@]|(?:{FEMALE}|{MALE}|{OTHER}) "

#: Letters by script, and syllables and endings of made-up names.
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga go ha he jo ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te ti to va ve vi".split(),
    "cyrillic": "ба бо ва ве да де ди га го ка ко ла ле ли ма ме ми на не ни по ра ре ри ро са се та те ти то фа".split(),
    "greek": "βα γα δα δη θα θε κα κο λα λε λι μα με μι να νε νι πα πε ρα ρε ρι ρο σα σε τα τε τι το φα".split(),
}
ENDINGS = {
    ("latin", "f"): "na", ("latin", "m"): "rt", ("latin", "u"): "lin", ("cyrillic", "f"): "на", ("cyrillic", "m"): "р", ("cyrillic", "u"): "ль",
    ("greek", "f"): "νη", ("greek", "m"): "ος", ("greek", "u"): "ης", ("latin", "surname"): "mer", ("cyrillic", "surname"): "ко", ("greek", "surname"): "ου",
}

#: Draws after which a short format is lengthened, as it may have no free surrogate left.
LENGTHEN_AFTER = 4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _byte(digest: Column, at: Column) -> Column:
    """Byte ``at`` (from 0, around the end) of a hexadecimal digest."""
    return F.conv(F.substr(digest, (at % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, byte: Column) -> Column:
    return F.substr(F.lit(alphabet), byte % len(alphabet) + 1, F.lit(1))


def _masked(s: Column, digest: Column) -> Column:
    """Each letter and digit of a lower-case text replaced by one of its script; other characters stay."""

    def one(i: Column) -> Column:
        c, b = F.substr(s, i, F.lit(1)), _byte(digest, i - 1)
        return (
            F.when(c.rlike("[0-9]"), _pick("0123456789", b)).when(c.rlike(r"\p{IsCyrillic}"), _pick(CYRILLIC, b))
            .when(c.rlike(r"\p{IsGreek}"), _pick(GREEK, b)).when(c.rlike(r"\p{L}"), _pick(LATIN, b)).otherwise(c)
        )

    return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), "")).otherwise("")


def _luhn(digits: Column) -> Column:
    """The check digit that belongs after ``digits``."""
    n = F.length(digits)

    def weigh(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return (10 - F.aggregate(F.sequence(F.lit(1), n), F.lit(0), weigh) % 10) % 10


def _card(canon: Column, digest: Column) -> Column:
    """Digits with a right check digit if the entity has one, with a wrong one if not."""
    body, last = F.substr(canon, F.lit(1), F.length(canon) - 1), F.substr(canon, F.length(canon), F.lit(1)).cast("int")
    valid = _luhn(body) == last
    return _let(_masked(body, digest), lambda new: F.concat(
        new, ((_luhn(new) + F.when(valid, 0).otherwise(1 + _byte(digest, F.lit(31)) % 9)) % 10).cast("string")
    ))


def _mod97(s: Column) -> Column:
    """The number that digits and letters (a to z as 10 to 35) spell, modulo 97."""

    def add(total: Column, i: Column) -> Column:
        v = F.conv(F.substr(s, i, F.lit(1)), 36, 10).cast("int")
        return (total * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _iban(canon: Column, digest: Column) -> Column:
    """The same country, and right check digits if the entity has them, wrong ones if not."""
    country = F.substr(canon, F.lit(1), F.lit(2))
    wrong = F.when(_mod97(F.concat(F.substr(canon, F.lit(5)), F.substr(canon, F.lit(1), F.lit(4)))) == 1, 0).otherwise(1 + _byte(digest, F.lit(31)) % 96)
    return _let(_masked(F.substr(canon, F.lit(5)), digest), lambda body: F.concat(
        country, F.lpad(((96 - _mod97(F.concat(body, country, F.lit("00"))) + wrong) % 97 + 2).cast("string"), 2, "0"), body
    ))


#: The private and loopback ranges, and half the bits that tell addresses in them apart.
RANGES = [(r"^(10|127)\.", 12), (r"^172\.(1[6-9]|2[0-9]|3[01])\.", 10), (r"^192\.168\.", 8)]


def _local(kind: Column, canon: Column) -> Column:
    return (kind == "ip") & canon.rlike("|".join(pattern for pattern, _ in RANGES))


def _permuted(x: Column, half: int, key: str) -> Column:
    """A keyed permutation of the numbers below ``4 ** half`` without fixed points: there, one on, and back again by a Feistel network."""
    base = 1 << half

    def mixed(i: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"ip {half}"), i.cast("string"), r.cast("string")), 256)
        return F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("long") % base

    def halves(n: Column) -> Column:
        return F.struct(F.floor(n / base).alias("l"), (n % base).alias("r"))

    there = lambda s, i: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(mixed(i, s["r"])).alias("r"))
    back = lambda s, i: F.struct(s["r"].bitwiseXOR(mixed(i, s["l"])).alias("l"), s["l"].alias("r"))
    whole = lambda s: s["l"] * base + s["r"]
    on = F.aggregate(F.array(*map(F.lit, range(4))), halves(x), there, lambda s: (whole(s) + 1) % (base * base))
    return _let(on, lambda n: F.aggregate(F.array(*map(F.lit, (3, 2, 1, 0))), halves(n), back, whole))


def _ip(canon: Column, digest: Column, key: str) -> Column:
    """Four octets. Addresses of a private or loopback range change places within it; others are drawn outside of these."""
    number = F.aggregate(F.split(canon, r"\."), F.lit(0).cast("long"), lambda n, o: n * 256 + o.cast("long"))
    out = F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == 0, _byte(digest, i) % 116 + 11).otherwise(_byte(digest, i) % 254 + 1).cast("string")
    ), ".")

    def moved(half: int) -> Column:
        size = 1 << 2 * half
        return _let(number, lambda n: _let(n - n % size + _permuted(n % size, half, key), lambda new: F.array_join(F.transform(
            F.array(*(F.lit(1 << bits).cast("long") for bits in (24, 16, 8, 0))), lambda unit: (F.floor(new / unit) % 256).cast("string")
        ), ".")))

    for pattern, half in RANGES:
        out = F.when(canon.rlike(pattern), moved(half)).otherwise(out)
    return out


def _name(kind: Column, digest: Column, attempt: Column) -> Column:
    """Syllables and an ending by script and gender, in lower case; later draws are longer."""

    def word(script: str) -> Column:
        syllables, n = F.array(*map(F.lit, SYLLABLES[script])), len(SYLLABLES[script])
        length = 3 + F.floor(attempt / LENGTHEN_AFTER).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(1), length), lambda i: F.get(syllables, _byte(digest, i) % n)), "")

    out = F.lit(None).cast("string")
    for (script, part), ending in ENDINGS.items():
        out = F.when(kind == f"{part}:{script}", F.concat(word(script), F.lit(ending))).otherwise(out)
    return out


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of the ``attempt``-th surrogate of an entity."""

    def draw(digest: Column) -> Column:
        local, domain = F.split(canon, "@")[0], F.split(canon, "@")[1]
        top = F.regexp_extract(domain, r"\.[^.]+$", 0)
        longer = F.when(attempt >= LENGTHEN_AFTER, _masked(F.repeat(F.lit("0"), F.floor(attempt / 2).cast("int")), F.sha2(digest, 256))).otherwise("")
        of_domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256)
        address = F.concat(_masked(local, digest), longer, F.lit("@"), _masked(F.regexp_replace(domain, r"\.[^.]+$", ""), of_domain), top)
        return (
            F.when(kind == "email", address).when(kind == "card", _card(canon, digest)).when(kind == "ip", _ip(canon, digest, key))
            .when(kind == "iban", _iban(canon, digest)).when(kind.isin("phone", "ssn"), _masked(canon, digest)).otherwise(_name(kind, digest, attempt))
        )

    return _let(F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256), draw)


def kind_of(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email").when(m.rlike(f"^(?:{IBAN})$"), "iban").when(m.rlike(f"^(?:{PHONE})$"), "phone")
        .when(m.rlike(f"^(?:{SSN})$"), "ssn").when(m.rlike(f"^(?:{CARD})$"), "card").when(m.rlike(f"^(?:{IP})$"), "ip").otherwise("name")
    )


def entities_of(m: Column) -> Column:
    """The entities of a match as an array of ``(kind, canon)``: one, or the given name and the surname after a title."""
    one = lambda k, c: F.array(F.struct(F.lit(k).alias("kind"), c.alias("canon")))
    script = F.when(m.rlike(r"\p{IsCyrillic}"), "cyrillic").when(m.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    gender = F.when(m.rlike(f"^(?:{FEMALE}) "), "f").when(m.rlike(f"^(?:{MALE}) "), "m").otherwise("u")
    words = F.slice(F.split(m, " +"), 2, 2)
    names = F.transform(words, lambda w, i: F.struct(
        F.concat_ws(":", F.when(i == F.size(words) - 1, "surname").otherwise(gender), script).alias("kind"), F.lower(w).alias("canon")
    ))
    return _let(kind_of(m), lambda k: (
        F.when(k == "email", one("email", F.lower(m))).when(k == "iban", one("iban", F.lower(F.regexp_replace(m, " ", ""))))
        .when(k == "phone", one("phone", F.right(_digits(m), F.lit(10)))).when(k == "ssn", one("ssn", _digits(m)))
        .when(k == "card", one("card", _digits(m))).when(k == "ip", one("ip", F.regexp_replace(m, r"(^|\.)0+(?=[0-9])", "$1"))).otherwise(names)
    ))


def _cased(pattern: Column, s: Column) -> Column:
    """``s`` in capitals where ``pattern`` has capitals; what is longer follows the last letter."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.when(
        F.substr(pattern, F.least(i, F.length(pattern)), F.lit(1)).rlike(r"\p{Lu}"), F.upper(F.substr(s, i, F.lit(1)))
    ).otherwise(F.substr(s, i, F.lit(1)))), "")


def _laid(m: Column, new: Column, wanted: str) -> Column:
    """The characters of ``new`` put in place of the last ones of ``m`` that are ``wanted``, separators kept."""
    count = lambda s: F.length(F.regexp_replace(s, f"[^{wanted}]", ""))
    skip = count(m) - F.length(new)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: _let(count(F.substr(m, F.lit(1), i)), lambda k: (
        F.when(F.substr(m, i, F.lit(1)).rlike(f"[{wanted}]") & (k > skip), F.substr(new, k - skip, F.lit(1))).otherwise(F.substr(m, i, F.lit(1)))
    ))), "")


def _written(m: Column, new: Column) -> Column:
    """The surrogates ``new`` of a match's entities in the form in which the match is written."""
    head = F.regexp_extract(m, r"^\S+ +", 0)
    return _let(kind_of(m), lambda k: (
        F.when(k == "email", _cased(m, new[0])).when(k == "iban", _laid(m, F.upper(new[0]), "A-Z0-9")).when(k == "ip", new[0])
        .when(k == "name", F.concat(head, F.array_join(F.transform(new, F.initcap), " "))).otherwise(_laid(m, new[0], "0-9"))
    ))


def _found(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(documents: DataFrame) -> DataFrame:
    """The distinct ``(kind, canon)`` of all texts; merged in each task before the shuffle."""
    matches = documents.select(F.explode(_found(F.col("text"))).alias("m"))
    return matches.select(F.inline(entities_of(F.col("m")))).distinct()


def gendered(found: DataFrame) -> DataFrame:
    """``(kind, canon, as_kind)``: given names without gender take the one gender with which the texts have them, if it is one."""
    known = found.where(F.col("kind").rlike("^[fm]:")).select("canon", F.col("kind").alias("as_kind"), F.concat(F.lit("u:"), F.split("kind", ":")[1]).alias("kind"))
    one = known.groupBy("kind", "canon").agg(F.min("as_kind").alias("as_kind"), F.max("as_kind").alias("other")).where("as_kind = other").drop("other")
    return found.join(one, ["kind", "canon"], "left").select("kind", "canon", F.coalesce("as_kind", "kind").alias("as_kind"))


def redraws(found: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """``(kind, canon, attempt)`` of the entities whose first surrogate will not do.

    A surrogate must not be an entity of the same kind, nor another entity's surrogate: of entities that
    draw the same one, the smallest keeps it, the others draw again. Raises if ``rounds`` draws do not suffice.
    Addresses of private ranges are permuted, not drawn, so they never collide.
    """
    found = found.where(~_local(F.col("kind"), F.col("canon")))
    kept, open_ = None, found.withColumn("attempt", F.lit(0))
    originals = found.select("kind", F.col("canon").alias("new"))
    for _ in range(rounds):
        drawn = materialize(open_.withColumn("new", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)), "drawn")
        free = drawn.join(originals, ["kind", "new"], "left_anti")
        if kept is not None:
            free = free.join(kept.select("kind", "new"), ["kind", "new"], "left_anti")
        first = materialize(free.groupBy("kind", "new").agg(F.min(F.struct("canon", "attempt")).alias("w")).select("kind", "w.canon", "w.attempt", "new"), "kept")
        kept = first if kept is None else materialize(kept.union(first), "kept")
        open_ = materialize(drawn.join(first, ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), "open")
        if open_.isEmpty():
            return kept.where("attempt > 0").select("kind", "canon", "attempt")
    raise RuntimeError("no free surrogates left")


def pseudonymize(documents: DataFrame, key: str) -> DataFrame:
    """All documents with their personal data replaced; ``n_replaced`` counts the replacements of a text.

    Kinds: e-mail addresses, account numbers (IBAN), phone numbers, social security numbers, card numbers,
    IP addresses, and names after a title. Different entities get different surrogates, none of which is an
    entity of the texts; only addresses of private and loopback ranges, which the texts may fill, are permuted within their range, none
    onto itself. Check digits (cards, IBAN) are right where the entity's are. Texts are rewritten where they lie. Only where a
    surrogate had to be drawn again, or a name takes its gender from elsewhere, this comes by a join on the hash of the text.

    Null and empty texts stay; null ids and repeated rows are treated like others. ``n_chars``, if there is
    such a column, is counted anew for changed texts; other columns are carried along, but for a column ``n_replaced``, which is replaced.
    """
    documents = documents.drop("n_replaced")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    of_text, draws, found = (free_name(documents, c) for c in ("of_text", "draws", "found"))
    known = materialize(gendered(materialize(entities(documents), "entities")), "gendered")
    again = redraws(known.select(F.col("as_kind").alias("kind"), "canon").distinct(), key).withColumnRenamed("kind", "as_kind")
    special = materialize(
        known.join(again, ["as_kind", "canon"], "left").where("attempt is not null or kind <> as_kind")
        .select("kind", "canon", F.struct("as_kind", F.coalesce("attempt", F.lit(0)).alias("attempt")).alias("drawn")), "special",
    )
    if special.isEmpty():
        drawn, rows = None, documents
    else:
        parts = documents.where("text is not null").select(F.xxhash64("text").alias("t"), F.explode(_found(F.col("text"))).alias("m"))
        hit = parts.select("t", F.inline(entities_of(F.col("m")))).join(special, ["kind", "canon"]).distinct()
        by_text = hit.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "drawn"))).alias(draws))
        rows = documents.withColumn(of_text, F.xxhash64("text")).join(by_text.withColumnRenamed("t", of_text), of_text, "left")
        drawn = F.col(draws)

    def replaced(m: Column) -> Column:
        def new(e: Column) -> Column:
            if drawn is None:
                return surrogate(e["kind"], e["canon"], F.lit(0), key)
            own = F.get(F.map_values(F.map_filter(drawn, lambda k, _: k == F.concat_ws("|", e["kind"], e["canon"]))), F.lit(0))
            return _let(own, lambda d: surrogate(F.coalesce(d["as_kind"], e["kind"]), e["canon"], F.coalesce(d["attempt"], F.lit(0)), key))

        return _let(F.transform(entities_of(m), new), lambda s: _written(m, s))

    text = F.col("text")
    rows = rows.select(*columns, *([] if drawn is None else [draws]), _found(text).alias(found))
    new = F.when(F.size(found) > 0, F.array_join(F.zip_with(
        F.split(text, PATTERN, -1), F.transform(found, replaced), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))
    ), "")).otherwise(text)
    out = rows.withColumn("text", new)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns, F.when(text.isNull(), 0).otherwise(F.size(found)).cast("long").alias("n_replaced"))
