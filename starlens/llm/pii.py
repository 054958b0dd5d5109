"""Personal data replaced by keyed surrogates of the same type, with DataFrame operations only.

One pattern finds the entities.  Their distinct normal forms make up a table; each gets a surrogate from a
keyed hash that keeps kind, length and format (digits for digits, letters of the same script and case, valid
check digits, names of the same gender and script).  Proposals are checked over the whole table: two entities
never share a surrogate, and none is the value of a real entity; losers propose again.  The same entity has the
same surrogate everywhere, in whatever format it is written.  A person's is made of surrogates of the name's words,
so that a short mention and the full name agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import stored

KINDS = ("email", "person", "iban", "ip", "phone", "card", "ssn")

_FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|г-жа|Госпожа|Κυρία"
_MALE = r"Mr|Herr|Monsieur|Señor|Sr|г-н|Господин|Κύριος"
_TITLE = rf"(?:{_FEMALE}|{_MALE}|Dra|Dr|Doctor|Doktor|Professor|Prof)"
_TITLES = rf"{_TITLE}\.?(?: {_TITLE}\.?){{0,8}} "
_PARTICLE = r"(?:von|van|vom|der|den|de|del|della|di|da|dos|das|du|la|le|zu|zur|zum|ten|ter|bin|ibn|al|el|af|av|y)"
# Groups that may repeat without end are possessive: others are matched by recursion, which a long name overflows.
_WORD = r"(?:\p{L}['’])?\p{Lu}[\p{L}\p{M}]++(?:-[\p{L}\p{M}]++|['’]\p{Lu}[\p{L}\p{M}]++)*+"
_LED_WORD = rf"(?:(?:\p{{Lu}}\.?|{_PARTICLE}) |\p{{Lu}}\.)*+{_WORD}"
_NAME = rf"{_LED_WORD}(?: {_LED_WORD})*+"
_LOCAL = r"[\p{L}\p{N}._%+-]"
_EMAIL = rf"(?<!{_LOCAL})[\p{{L}}\p{{N}}]{_LOCAL}*+@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)++"
_PERSON = rf"(?<![\p{{L}}\p{{N}}]){_TITLES}{_NAME}(?!\p{{L}})"
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP = rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}])(?!\.[0-9])"
_PHONE = (
    r"(?<![\p{L}\p{N}])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}])"
)
_CARD = r"(?<![\p{L}\p{N}])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\p{L}\p{N}])"
_SSN = r"(?<![\p{L}\p{N}])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}])"
PATTERN = "|".join((_EMAIL, _PERSON, _IBAN, _IP, _PHONE, _CARD, _SSN))

# Given names by script and gender, family names by script.
NAMES = {
    "latin": {
        "f": "Anna Maria Clara Elena Julia Laura Sofia Emma Nora Alice Ida Eva Lena Marta Rosa Vera Irene Paula".split(),
        "m": "Paul Martin David Thomas Felix Simon Leo Oscar Hugo Victor Anton Bruno Carlo Daniel Emil Karl".split(),
        "last": "Berg Keller Moreau Santos Fischer Laurent Vidal Winter Lindner Rossi Dupont Navarro Hansen Weber "
        "Marin Costa Stone Carter Miller Blanc Romero Huber Lang Ferrer".split(),
    },
    "cyrillic": {
        "f": "Анна Мария Елена Ольга Ирина Вера Нина Юлия".split(),
        "m": "Иван Пётр Павел Сергей Антон Олег Борис Игорь".split(),
        "last": "Орлов Белов Громов Зайцев Лебедев Морозов Соколов Титов".split(),
    },
    "greek": {
        "f": "Άννα Μαρία Ελένη Σοφία Ειρήνη Κατερίνα".split(),
        "m": "Γιώργος Νίκος Πέτρος Παύλος Ανδρέας Κώστας".split(),
        "last": "Παππάς Γεωργίου Νικολάου Ιωάννου Δημητρίου Βασιλείου".split(),
    },
}
# Letters that stand for letters: first and number, by what the original is.
ALPHABETS = (("[a-z]", "a", 26), ("[A-Z]", "A", 26), ("[а-я]", "а", 32), ("[А-Я]", "А", 32), ("[α-ω]", "α", 25),
             (r"\p{Ll}", "a", 26), (r"\p{L}", "A", 26))
#: After so many proposals in its own format an entity gets one more character for every further one.
PROPOSALS = 8


def kind_of(value: Column) -> Column:
    tests = (
        ("email", F.contains(value, F.lit("@"))),
        ("person", value.rlike(rf"^{_TITLES}")),
        ("iban", value.rlike("^[A-Z]")),
        ("ip", value.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")),
        ("ssn", value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        ("phone", value.rlike(r"^[+(]|^[0-9]{3}[.-][0-9]{3}[.-]")),
    )
    out = F.lit("card")
    for kind, test in reversed(tests):
        out = F.when(test, F.lit(kind)).otherwise(out)
    return out


def normal_form(kind: Column, value: Column) -> Column:
    """What all spellings of one entity share: letters and digits that count."""
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "ip", value)
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .otherwise(F.regexp_replace(value, "[^0-9]", ""))
    )


def parts_of(kind: Column, value: Column) -> Column:
    """What has a surrogate of its own in an entity: (kind, norm, word) of each word of a person's name, or the whole.

    A name's last word is the family name, whoever bears it; those before are given names, initials and particles.
    Without a title that tells, the ending of a given name stands for its gender.
    """
    title = F.regexp_extract(value, rf"^{_TITLES}", 0)
    spaced = F.regexp_replace(F.regexp_replace(value, rf"^{_TITLES}", ""), r"(?<=\p{Lu}\.)(?=\p{L})", " ")
    # Worked out once for an entity; inside the lambda they would be for each of its words.
    female, male = (title.rlike(rf"(?:^| )(?:{x})\.? ") for x in (f"{_FEMALE}|Dra", _MALE))
    once = F.array(F.struct(F.split(spaced, " ").alias("words"), female.alias("female"), male.alias("male")))

    def part(w: Column, i: Column, all_of: Column) -> Column:
        norm = F.translate(F.lower(w), "’", "'")
        female, male = all_of["female"], all_of["male"]
        name = (
            F.when(i == F.size(all_of["words"]) - 1, "family")
            .when(w.rlike(r"^\p{Lu}\.?$"), "initial")
            .when(w.rlike(rf"^{_PARTICLE}$"), "particle")
            .when(female | (~male & norm.rlike("[aаяαάη]$")), "given f")
            .otherwise("given m")
        )
        return F.struct(
            name.alias("kind"), F.when(name == "initial", F.substring(norm, 1, 1)).otherwise(norm).alias("norm"), w.alias("word")
        )

    whole = F.struct(kind.alias("kind"), normal_form(kind, value).alias("norm"), value.alias("word"))
    parts = F.flatten(F.transform(once, lambda o: F.transform(o["words"], lambda w, i: part(w, i, o))))
    return F.when(kind == "person", parts).otherwise(F.array(whole))


def _bytes(seed: Column) -> Column:
    """128 numbers from 0 to 255 that follow from ``seed``."""
    digest = F.concat(*(F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(4)))
    return F.transform(
        F.regexp_extract_all(digest, F.lit("[0-9a-f]{2}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int")
    )


def _like(value: Column, numbers: Column) -> Column:
    """Every letter and digit replaced by one of the same class."""

    def one(c: Column, i: Column) -> Column:
        n = F.get(numbers, i % 128)
        out = F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
        for pattern, first, many in ALPHABETS:
            # Unicode code points by way of UTF-32: char() covers Latin only.
            point = F.lit(ord(first)) + n % many
            letter = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
            out = out.when(c.rlike(pattern), letter)
        return out.otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10."""
    reverse = F.reverse(F.split(digits, ""))

    def add(total: Column, pair: Column) -> Column:
        return total + pair

    doubled = F.transform(
        F.filter(reverse, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), add) % 10


def _valid_card(original: Column, proposal: Column) -> Column:
    """Keeps the first digit, and the last makes the number valid if the original is."""
    body = F.concat(F.substring(original, 1, 1), proposal.substr(F.lit(2), F.length(proposal) - 2))
    check = (F.lit(10) - _luhn(F.concat(body, F.lit("0")))) % 10
    return F.when(_luhn(original) == 0, F.concat(body, check.cast("string"))).otherwise(
        F.concat(body, F.substring(proposal, -1, 1))
    )


def _pick(names: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), n % len(names) + 1)


def _name(kind: Column, norm: Column, numbers: Column, attempt: Column) -> Column:
    """Name, in small letters, of the same kind, gender and script; retries add names (given names from the fifth on)."""
    script = F.when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").when(norm.rlike(r"\p{IsGreek}"), "greek")
    retries = F.when(kind == "family", attempt).otherwise(F.greatest(attempt - 4, F.lit(0)))
    places = F.sequence(F.lit(0), F.least(retries, F.lit(9)))

    def chain(names: list[str]) -> Column:
        return F.array_join(F.transform(places, lambda k: _pick(names, F.get(numbers, k + 1))), "-")

    def names(script: str) -> Column:
        out = None
        for name, part in (("family", "last"), ("given f", "f"), ("given m", "m")):
            made = chain([x.lower() for x in NAMES[script][part]])
            out = F.when(kind == name, made) if out is None else out.when(kind == name, made)
        return out

    return F.when(script == "cyrillic", names("cyrillic")).when(script == "greek", names("greek")).otherwise(names("latin"))


def _written_name(part: Column, surrogate: Column) -> Column:
    """A name's surrogate in capitals or with capital initials, as the word it replaces; particles stay."""
    word = part["word"]
    capital = F.replace(F.initcap(F.replace(surrogate, F.lit("-"), F.lit(" "))), F.lit(" "), F.lit("-"))
    return (
        F.when(part["kind"] == "particle", word)
        .when(part["kind"] == "initial", F.concat(F.upper(surrogate), F.when(F.endswith(word, F.lit(".")), ".").otherwise("")))
        .when((F.upper(word) == word) & (F.length(word) > 1), F.upper(surrogate))
        .otherwise(capital)
    )


def propose(kind: Column, norm: Column, key: str, attempt: Column) -> Column:
    """Surrogate (a normal form) of an entity; each attempt gives another."""
    n = _bytes(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")))
    longer = F.when(
        attempt >= PROPOSALS, F.lpad((F.get(n, 99) * 256 + F.get(n, 98)).cast("string"), attempt - PROPOSALS + 1, "7")
    ).otherwise("")
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    email = F.concat(
        _like(local, n),
        longer,
        F.lit("@"),
        _like(F.regexp_replace(F.substring_index(domain, ".", 1), "[^a-z0-9]", "x"), F.slice(F.concat(n, n), 65, 128)),
        F.lit(".example."),
        F.element_at(F.array(F.lit("com"), F.lit("org"), F.lit("net")), F.get(n, 97) % 3 + 1),
    )
    ip = F.concat_ws(".", F.lit("10"), F.get(n, 0), F.get(n, 1), F.get(n, 2) % 254 + 1)
    digits = F.concat(_like(norm, n), longer)
    iban = F.concat(F.substring(norm, 1, 2), _like(norm.substr(F.lit(3), F.length(norm)), n), longer)
    return (
        F.when(kind == "email", email)
        .when(kind.isin("family", "given f", "given m"), _name(kind, norm, n, attempt))
        .when(kind == "initial", F.regexp_replace(_like(F.repeat(norm, F.least(attempt, F.lit(9)) + 1), n), "(.)(?=.)", "$1. "))
        .when(kind == "ip", ip)
        .when(kind == "iban", iban)
        .when(kind == "card", _valid_card(norm, digits))
        .when(
            kind == "phone",  # what stands before ten digits is the country's code
            F.concat(norm.substr(F.lit(1), F.length(norm) - 10), digits.substr(F.greatest(F.length(norm) - 9, F.lit(1)), F.length(digits))),
        )
        .when(kind == "ssn", F.concat(F.lit("9"), digits.substr(F.lit(2), F.length(digits))))
        .otherwise(digits)
    )


def written(kind: Column, value: Column, surrogate: Column) -> Column:
    """A surrogate in the format of the spelling it replaces; a longer one keeps its rest at the end."""
    counted = F.when(kind == "iban", "[^A-Z0-9]").otherwise("[^0-9]")
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    place = F.transform(
        chars, lambda c, i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), counted, F.lit("")))
    )
    filled = F.array_join(
        F.transform(
            F.arrays_zip(chars.alias("c"), place.alias("p")),
            lambda x: F.when(
                F.regexp_replace(x["c"], counted, F.lit("")) != "", F.substring(surrogate, x["p"], F.lit(1))
            ).otherwise(x["c"]),
        ),
        "",
    )
    last = F.length(F.regexp_replace(value, counted, F.lit("")))
    return (
        F.when(kind.isin("email", "ip"), surrogate)
        .otherwise(F.concat(filled, surrogate.substr(last + 1, F.length(surrogate))))
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) for the distinct rows of ``entities``, all surrogates of a kind distinct.

    Each round every open entity proposes; of equal proposals the smallest entity's stands, unless it is
    taken already or a real value.  The rounds end when none is open: proposals get longer in the end.
    """
    every = stored(entities.select("kind", "norm").distinct())
    real = every.select("kind", F.col("norm").alias("proposal"))
    open_ones, accepted, attempt = every, [], 0
    while attempt == 0 or open_ones.limit(1).count():
        asked = open_ones.withColumn("proposal", propose(F.col("kind"), F.col("norm"), key, F.lit(attempt)))
        free = asked.join(real, ["kind", "proposal"], "left_anti")
        for earlier in accepted:
            free = free.join(earlier.select("kind", "proposal"), ["kind", "proposal"], "left_anti")
        won = stored(free.groupBy("kind", "proposal").agg(F.min("norm").alias("norm")))
        accepted.append(won)
        open_ones = stored(open_ones.join(won, ["kind", "norm"], "left_anti"))
        attempt += 1
    table = reduce(DataFrame.unionByName, accepted)
    return table.select("kind", "norm", F.col("proposal").alias("surrogate"))


def _fresh(name: str, taken: list[str]) -> str:
    while name.lower() in (t.lower() for t in taken):
        name = "_" + name
    return name


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rewritten and one more column, an array of (kind, value, surrogate).

    The column is named ``entities``, with underscores before it if ``docs`` has that already.  Null and empty
    texts stay as they are with an empty array.  Repeated rows and rows without id are rewritten alike; an
    empty table gives none; texts are rewritten whole.
    """
    found, known, row = (_fresh(name, docs.columns) for name in ("entities", "known", "row"))
    text = F.col(text_col)
    has = F.coalesce(text.rlike(PATTERN), F.lit(False))

    def entity(v: Column) -> Column:
        return F.struct(kind_of(v).alias("kind"), parts_of(kind_of(v), v).alias("parts"), v.alias("value"))

    marked = docs.filter(has).withColumn(
        found, F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), entity)
    )
    each = marked.select(F.col(id_col).alias("i"), F.explode(F.array_distinct(F.flatten(F.transform(found, _kinds_norms)))).alias("e"))
    each = stored(each.select("i", "e.kind", "e.norm").filter("kind <> 'particle'").distinct())
    table = surrogates(each, key)
    named = each.join(table, ["kind", "norm"]).select("i", F.concat_ws("\x1f", "kind", "norm").alias("k"), "surrogate")
    maps = named.groupBy(F.col("i").alias(row)).agg(F.map_from_entries(F.collect_list(F.struct("k", "surrogate"))).alias(known))
    joined = marked.join(maps, marked[id_col].eqNullSafe(maps[row])).drop(row)

    def surrogate_of(part: Column) -> Column:
        return F.element_at(F.col(known), F.concat_ws("\x1f", part["kind"], part["norm"]))

    def replaced(e: Column) -> Column:
        name = F.array_join(F.transform(e["parts"], lambda p: _written_name(p, surrogate_of(p))), " ")
        person = F.concat(F.regexp_extract(e["value"], rf"^{_TITLES}", 0), name)
        other = written(e["kind"], e["value"], surrogate_of(F.get(e["parts"], F.lit(0))))
        return F.struct(
            e["kind"].alias("kind"), e["value"].alias("value"), F.when(e["kind"] == "person", person).otherwise(other).alias("surrogate")
        )

    joined = joined.withColumn(found, F.transform(found, replaced)).drop(known)
    pieces = F.zip_with(
        F.split(text, PATTERN, -1),
        F.transform(found, lambda e: e["surrogate"]),
        lambda gap, s: F.concat(gap, F.coalesce(s, F.lit(""))),
    )
    joined = joined.withColumn(text_col, F.array_join(pieces, ""))
    none = F.array().cast("array<struct<kind:string,value:string,surrogate:string>>")
    rest = docs.filter(~has).withColumn(found, none)
    return joined.select(*docs.columns, found).unionByName(rest.select(*docs.columns, found))


def _kinds_norms(e: Column) -> Column:
    return F.transform(e["parts"], lambda p: F.struct(p["kind"].alias("kind"), p["norm"].alias("norm")))
