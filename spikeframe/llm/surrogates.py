"""Personal data replaced by keyed surrogates of the same type, in SQL functions only.

Entities are found by patterns in every whole text. A surrogate is a keyed, format-preserving
encryption of the entity: symbol after symbol is shifted within its own class (digit, vowel,
consonant; lower or upper case; per script, with all letters, marks and digits of Unicode) by an amount that the key, the entity's kind and all
other symbols determine. Such a step can be undone, so different entities of a kind always have
different surrogates and equal ones equal surrogates, in every document and run with that key,
without a table of all entities; `checked` groups the distinct entities of each run all the same. No shift is zero, so no
symbol of an entity stays but what its format keeps. Formats are kept: separators, lengths, case, vowels, a phone's country
code, a card's first digit and whether its check digit is valid, an address's last domain label, octets below 256; a person keeps the
title and the last letter of each name, which carry the gender.

Equal entities in different dress are one: addresses and names are encrypted in lower case, phone,
card and social security numbers by their digits alone (a phone's country code is found in the digits),
account numbers without their spaces.

Numbers inside decimal fractions are none of these, nor are bare digits that no card begins with
(time stamps). Persons are found after a title or after a phrase that announces a name, with all their names and
initials; a name with neither is not told from other capitalised words.

Defined results: a null text stays null; empty texts and texts without entities stay as they are;
repeated rows are rewritten row by row; extra columns pass through.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let

# Symbol classes; a symbol is only ever replaced by one of its own class.
ALPHABETS = (
    "0123456789",
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "áéíóú", "ÁÉÍÓÚ", "äöü", "ÄÖÜ", "àèìòù", "ÀÈÌÒÙ", "âêîôû", "ÂÊÎÔÛ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)
def _other_symbols():
    """All other letters, marks and digits: (those with case, class by class; where each class starts; runs of code points)."""
    known = set("".join(ALPHABETS))
    classes: dict[tuple, list[str]] = {}
    runs: list[list] = []
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)[0]
        if kind not in "LMN" or c in known:
            continue
        name, up, low = unicodedata.name(c, "CJK").split(" ")[0], c.upper(), c.lower()
        if up == low == c:
            if runs and runs[-1][1:] == [code - 1, name, kind]:
                runs[-1][1] = code
            else:
                runs.append([code, code, name, kind])
            continue
        # what doesn't survive a change of case never takes the place of what does
        plain = len(up) == len(low) == 1 and c in (up, low) and up.lower() == low and low.upper() == up
        classes.setdefault((name, plain, up != c, low != c) if plain else (), []).append(c)
    classes.setdefault("", []).extend(chr(a) for a, b, *_ in runs if a == b)
    classes.setdefault((), []).extend(own.pop() for own in list(classes.values()) if len(own) == 1)
    lists = [own for own in classes.values() if own]
    return ("".join("".join(own) for own in lists), [1 + sum(map(len, lists[:k])) for k in range(len(lists) + 1)],
            [(a, b) for a, b, *_ in runs if a < b])


#: Session setting with the key.
KEY = "spark.spikeframe.surrogates.key"
OTHERS, STARTS, RANGES = _other_symbols()
LETTERS = "".join(ALPHABETS)
LETTER_STARTS = [1 + sum(map(len, ALPHABETS[:k])) for k in range(len(ALPHABETS) + 1)]
# Titles that stand before a person's name, and phrases that announce one.
TITLES = ("Mrs|Mr|Ms|Miss|Mx|Herrn|Herr|Frau|Fräulein|Señorita|Señora|Señor|Sra|Srta|Sr|Doña|Don|Monsieur|Madame|Mademoiselle|"
          "Mme|Mlle|Maître|Sir|Lady|Lord|Dame|Drs|Dra|Dr|Doctor|Doktor|Docteur|Professorin|Professor|Professeur|Profesora|"
          "Profesor|Profa|Prof|Dipl\\.-Ing|Rev|Reverend|Judge|Captain|Capt|Colonel|Col|Major|Lieutenant|Lt|Sergeant|Sgt|"
          "Signora|Signor|Sig|Dott|господин|госпожа|Господин|Госпожа|г-н|г-жа|κύριος|κυρία|Κύριος|Κυρία")
CUES = ("[Mm]y name is|[Mm]y name's|[Nn]ame:|[Pp]atient:|[Cc]ustomer:|[Cc]ontact:|[Aa]uthor:|[Ss]igned by|[Ss]igned,|[Dd]ear|"
        "[Rr]egards,|[Ss]incerely,|[Mm]ein Name ist|[Ii]ch heiße|[Jj]e m'appelle|[Mm]on nom est|[Mm]e llamo|[Mm]i nombre es|"
        "[Nn]ombre:|[Nn]om:|[Мм]еня зовут|[Ии]мя:")
_ATOM = r"\p{L}\p{M}\p{N}._%+\-"
#: What titles begin with; what stands between a phrase and a name. Both only make searching faster.
_FIRST, _GAP = r"(?=[A-ZгГκΚ])", r"(?<=[sy:,retoт] )(?=[\p{Lu}\p{Lo}])"
_TITLED = rf"(?:(?:{TITLES})\.? )+"
_NAME = r"(?:[\p{Lu}\p{Lo}][\p{L}\p{M}'’\-]+|\p{Lu}\.(?:[ \-]?\p{Lu}\.)*|\p{Lu}(?= \p{Lu})|\p{Lo})"
_NAMES = rf"{_NAME}(?: (?:(?:von|van|vom|zu|zur|de|der|den|del|della|di|da|dos|du|la|le|bin|ibn|al|el|y) ){{0,3}}{_NAME})*"
_FREE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Where a number of digits may begin: not inside a decimal fraction.
_DIGITS = _FREE + r"(?<!\d[.,])"
# Capitalised words after a title or phrase that begin no name.
NO_NAMES = ("The|A|An|All|Any|Our|Your|My|This|That|These|Those|Sir|Madam|Customers?|Clients?|Readers?|Friends?|Colleagues?|Team|"
            "Members?|Users?|Editors?|Everyone|Service|Support|Total|Amount|Value|Number|League|River|Order|Date|Name|Address|"
            "Unknown|None|Anonymous|General|Public|Company|Department|Office|University|City|Street|Road|Lake|Mount|"
            "North|South|East|West|Damen|Herren|Kunden|Monsieur|Madame|Client|Cliente|Clientes|Der|Die|Das|Le|La|Les|El|Los|Las")
_REAL = rf"(?!(?:{NO_NAMES})(?![\p{{L}}\p{{M}}\p{{N}}]))"
#: Kinds in order of precedence: of alternatives at one place the first matches.
PATTERNS = {
    "email": rf"(?<![{_ATOM}])[{_ATOM}]++@[\p{{L}}\p{{M}}\p{{N}}\-]++(?:\.[\p{{L}}\p{{M}}\p{{N}}\-]++)+",
    "ip": _FREE + r"(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.\d)" + _END,
    "iban": _FREE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "card": _DIGITS + r"(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5}|[2-6]\d{12,18})" + _END,
    "ssn": _DIGITS + r"\d{3}-\d{2}-\d{4}" + _END,
    "phone": r"(?:\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .\-]?\d{2,4}){2,4}" + _END
             + r"|\(\d{3}\) ?\d{3}[ .\-]\d{4}" + _END + r"|\(0\d{1,4}\) ?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}" + _END
             + "|" + _DIGITS + r"(?:\d{3} \d{3}[ .\-]\d{4}|0\d{2,4}[ /\-]\d{5,8}|0\d{2,4}(?:[ ./\-]\d{2,4}){2,4}"
             + r"|0\d(?:[ .]\d{2}){4})" + _END + "|" + _DIGITS + r"(?:\d{3}[.\-]\d{3}[.\-]|\d{3}-)\d{4}" + _END + ")",
    "person": rf"{_FIRST}{_FREE}(?<!\b[Tt]he ){_TITLED}{_REAL}{_NAMES}|{_GAP}(?<={_FREE}(?:{CUES}) ){_REAL}{_NAMES}",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_CANDIDATE = rf"[@0-9]|{_FIRST}(?:{TITLES})\.? |{_GAP}(?<=(?:{CUES}) )"
_WHOLE = {kind: f"^(?:{p})$" for kind, p in PATTERNS.items()} | {"person": rf"^(?:{_TITLED})?{_NAMES}$"}
#: Digits of a country's code: one for 1 and 7, two for these, otherwise three.
_COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def entity_kind(value: Column) -> Column:
    return reduce(lambda rest, kind: F.when(value.rlike(_WHOLE[kind]), F.lit(kind)).otherwise(rest),
                  list(PATTERNS)[::-1], F.lit("phone"))


def _random(key: str, kind: str, *parts: Column) -> Column:
    """A keyed number below 2^48."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 12), 16, 10).cast("long")


def _numbers(numbers) -> Column:
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")


def _moved(place: Column, starts, stops, amount: Column) -> Column:
    """Another place of the same run of places (starts to stops, both included); null outside all runs."""
    def within(run: Column) -> Column:
        size = run["stop"] - run["start"] + 1
        to = (place - run["start"] + 1 + amount % (size - 1)) % size + run["start"]
        return F.when(place.between(run["start"], run["stop"]), to.cast("int"))

    def of(own: Column) -> Column:
        return let(F.struct(F.get(_numbers(starts), own - 1).alias("start"), F.get(_numbers(stops), own - 1).alias("stop")), within)

    return let(F.size(F.filter(_numbers(starts), lambda x: x <= place)), of)


def _within(symbol: Column, amount: Column, letters: str, starts: list[int]) -> Column:
    moved = let(F.position(symbol, F.lit(letters)), lambda place: _moved(place, starts[:-1], [x - 1 for x in starts[1:]], amount))
    return let(moved, lambda to: F.when(to.isNotNull(), F.substring(F.lit(letters), to, F.lit(1))))


def _shifted(symbol: Column, amount: Column, plain: bool) -> Column:
    """Another symbol of the same class, or the symbol where it has none."""
    if plain:
        return F.coalesce(_within(symbol, amount, LETTERS, LETTER_STARTS), symbol)
    ranged = let(F.ascii(symbol), lambda code: _moved(code, *zip(*RANGES), amount))
    char = let(ranged, lambda to: F.when(to.isNotNull(), F.decode(F.unhex(F.lpad(F.hex(to), 8, "0")), "UTF-32")))
    return F.coalesce(_within(symbol, amount, LETTERS, LETTER_STARTS),
                      F.when(F.ascii(symbol) >= 128, F.coalesce(char, _within(symbol, amount, OTHERS, STARTS))), symbol)


def encrypted(value: Column, key: str, kind: str, keep_last: bool = False, plain: bool = False) -> Column:
    """The value with every symbol of a class shifted within it; one reversible step per symbol.

    keep_last: the last of several symbols stays. plain: only symbols of ALPHABETS can occur.
    """
    def step(s: Column, i: Column) -> Column:
        before, after = F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))
        amount = _random(key, kind, i, before, after)

        return F.concat(before, let(F.struct(F.substring(s, i, F.lit(1)).alias("symbol"), amount.alias("amount")),
                                    lambda x: _shifted(x["symbol"], x["amount"], plain)), after)

    last = F.length(value) - (F.when(F.length(value) > 1, 1).otherwise(0) if keep_last else 0)
    return F.when(last < 1, value).otherwise(F.aggregate(F.sequence(F.lit(1), last), value, step))


def _replaced(value: Column, symbols: Column, skip: Column, kind: str) -> Column:
    """The value with what the character class `kind` has of it, all but the first `skip`, replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("seen"))

    def step(acc: Column, c: Column) -> Column:
        seen = acc["seen"] + F.when(c.rlike(kind), 1).otherwise(0)
        new = F.when(c.rlike(kind) & (seen > skip), F.substring(symbols, seen - skip, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["out"], new).alias("out"), seen.alias("seen"))

    return F.aggregate(F.split(value, ""), start, step, lambda acc: acc["out"])


def _number(value: Column, key: str, kind: str, skip: Column, symbols: str = "[0-9]") -> Column:
    found = F.substring(F.regexp_replace(value, symbols.replace("[", "[^"), ""), skip + 1, F.length(value))
    return _replaced(value, encrypted(found, key, kind, plain=True), skip, symbols)


def _check_sum(digits: Column) -> Column:
    """The last digit's place in the sum that makes a card number valid: it is valid if this is 0."""
    def add(acc: Column, d: Column) -> Column:
        d = d.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.struct((acc["sum"] + F.when(acc["twice"], twice).otherwise(d)).alias("sum"), (~acc["twice"]).alias("twice"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("twice"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda acc: acc["sum"] % 10)


def _card(value: Column, key: str) -> Column:
    """First digit kept; the last one differs from a valid check digit by as much as before, so valid stays
    valid and different cards stay different."""
    def checked_last(x: Column) -> Column:
        off = F.pmod(_check_sum(x["old"]) - _check_sum(F.concat(x["new"], F.lit("0"))), F.lit(10))
        return F.concat(x["new"], off.cast("string"))

    digits = F.regexp_replace(value, "[^0-9]", "")
    middle = F.substring(digits, F.lit(2), F.length(digits) - 2)
    new = F.concat(F.substring(digits, 1, 1), encrypted(middle, key, "card", plain=True))
    last = let(F.struct(digits.alias("old"), new.alias("new")), checked_last)
    return _replaced(value, last, F.lit(0), "[0-9]")


def _address(value: Column, key: str) -> Column:
    """Local part and domain labels, the last one kept; upper case stays upper case."""
    low = F.lower(value)
    head = F.regexp_extract(low, r"^(.*)(\.[^.]+)$", 1)
    new = F.concat(encrypted(head, key, "email"), F.regexp_extract(low, r"^(.*)(\.[^.]+)$", 2))
    return F.when((value == F.upper(value)) & (value != low), F.upper(new)).otherwise(new)


def _octets(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, "[.]"), lambda x: x.cast("int"))

    def step(p: Column, i: Column) -> Column:
        others = F.array_join(F.transform(p, lambda x, j: F.when(j == i, F.lit("*")).otherwise(x.cast("string"))), ".")
        amount = (_random(key, "ip", i, others) % 255).cast("int") + 1
        return F.transform(p, lambda x, j: F.when(j == i, (x + amount) % 256).otherwise(x))

    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(3)), parts, step), ".")


def _person(value: Column, key: str) -> Column:
    """Title kept; every name encrypted in lower case, its last letter kept, and written as before."""
    title = F.regexp_extract(value, rf"^(?:{_TITLED})?", 0)
    names = F.split(F.substring(value, F.length(title) + 1, F.length(value)), " ")

    def one(name: Column) -> Column:
        low = F.lower(name)
        return let(encrypted(low, key, "person", keep_last=True), lambda new: dressed(name, low, new))

    def dressed(name: Column, low: Column, new: Column) -> Column:
        cased = F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))
        return F.when(name == low, new).when((name == F.upper(name)) & (F.length(name) > 1), F.upper(new)).otherwise(cased)

    return F.concat(title, F.array_join(F.transform(names, one), " "))


def surrogate(value: Column, kind: Column, key: str) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    country = F.when(value.startswith("+"), F.length(F.regexp_extract(digits, _COUNTRY, 0))).otherwise(0)
    return (F.when(kind == "email", _address(value, key))
            .when(kind == "ip", _octets(value, key))
            .when(kind == "iban", _number(value, key, "iban", F.lit(2), "[0-9A-Z]"))
            .when(kind == "card", _card(value, key))
            .when(kind == "ssn", _number(value, key, "ssn", F.lit(0)))
            .when(kind == "person", _person(value, key))
            .otherwise(_number(value, key, "phone", country)))


def entities(text: Column) -> Column:
    """Array of (kind, value) in the order of the text; empty for texts that can't have any."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)),
                        lambda v: F.struct(entity_kind(v).alias("kind"), v.alias("value")))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return F.when(text.rlike(_CANDIDATE), found).otherwise(none)


def _given(docs: DataFrame, key: str | None) -> str:
    """The key, or the session's: who has it can undo every surrogate, so there is no default."""
    key = key or docs.sparkSession.conf.get(KEY, None)
    if not key:
        raise ValueError(f"pass a key, or set {KEY}")
    return key


def rewritten(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with `text` rewritten and `entities` (kind, value, surrogate) found in it."""
    key = _given(docs, key)
    text = F.col("text")
    named = F.transform(entities(text), lambda e: e.withField("surrogate", surrogate(e["value"], e["kind"], key)))
    found = docs.withColumn("entities", F.coalesce(named, F.array().cast(
        "array<struct<kind:string,value:string,surrogate:string>>")))
    gaps = F.split(text, ENTITY, -1)
    joined = F.array_join(F.zip_with(gaps, F.col("entities.surrogate"), lambda gap, s: F.concat(
        F.coalesce(gap, F.lit("")), F.coalesce(s, F.lit("")))), "")
    return found.withColumn("text", F.when(F.size("entities") > 0, joined).otherwise(text))


def checked(docs: DataFrame, key: str | None = None, attempts: int = 4) -> DataFrame:
    """`rewritten`, written once; with another key made of the given one while different entities share a surrogate."""
    key = _given(docs, key)
    for k in range(attempts):
        scratch = Scratch(docs.sparkSession, "surrogates")
        rows = scratch.write(rewritten(docs, f"{key}#{k}" if k else key), "rows")
        if _collisions(rows).isEmpty():
            return rows
        scratch.delete()
    raise RuntimeError("surrogates or entities aren't one to one; see surrogates.collisions")


def report(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, rewritten text and how many entities of each kind it had."""
    rows = checked(docs.select("doc_id", "text"), key)

    def count(kind: str) -> Column:
        return F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", "text", *[count(kind) for kind in PATTERNS])


def without_personal_data(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The documents with rewritten texts; `n_chars` follows the text."""
    own = "entities" in docs.columns
    rows = checked(docs.withColumnRenamed("entities", "__own_entities") if own else docs, key).drop("entities")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType))
    return (rows.withColumnRenamed("__own_entities", "entities") if own else rows).select(
        *[f"`{c}`" for c in docs.columns])


def identity(value: Column, kind: Column) -> Column:
    """What makes two entities of a kind the same."""
    return F.when(kind.isin("phone", "card", "ssn"), F.concat(
        F.when(value.startswith("+"), "+").otherwise(""), F.regexp_replace(value, "[^0-9]", ""))).when(
        kind.isin("email", "person"), F.lower(value)).when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).otherwise(value)


def _collisions(rows: DataFrame) -> DataFrame:
    pairs = (rows.select(F.explode("entities").alias("e"))
             .select("e.kind", identity(F.col("e.value"), F.col("e.kind")).alias("value"),
                     identity(F.col("e.surrogate"), F.col("e.kind")).alias("surrogate")).distinct())
    two = [pairs.groupBy("kind", F.col(by).alias("name")).count().where("count > 1") for by in ("surrogate", "value")]
    return two[0].union(two[1])


def collisions(docs: DataFrame, key: str | None = None) -> DataFrame:
    """kind and surrogate of different entities with equal surrogates, or of one with several; none is expected."""
    return _collisions(rewritten(docs.select("text"), key))
