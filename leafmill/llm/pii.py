"""PII surrogates in DataFrame functions only.

Entities (mail addresses, phone numbers, card and account numbers, IPv4 addresses, secrets, names behind a title, known given
names with a surname behind them) are found by one pattern, and each is replaced by a value drawn from a keyed digest of its canonical form: the same entity gets the same
surrogate everywhere, however it is spelled.  Surrogates keep kind, format, letter case, script, the gender of a title or given
name, country codes, private address ranges and valid check digits (cards by Luhn, accounts by 97).

Distinctness: over all entities of the table, two canonical forms never share a surrogate, and no surrogate is an entity that
occurs.  The losers of such a collision draw again until none is left; only their documents are joined with the later draws.

Defined results: a null text stays null; a text without entities stays byte for byte; repeated rows are replaced alike; null
ids do not matter, nor do names of extra columns (where one is called like the added count, that gets a number behind its name);
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.rows import free_names
from leafmill.staging import materialize, release

#: Titles and given names by gender and script: fixed values.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа"]
MALE_NAMES = ["Adrian", "Bruno", "Conrad", "Dario", "Edgar", "Felix", "Gustav", "Hugo", "Ivan", "Jonas", "Konrad", "Lukas", "Marcel", "Nico", "Oscar", "Pavel"]
FEMALE_NAMES = ["Alma", "Bianca", "Carla", "Doris", "Elena", "Flora", "Greta", "Helga", "Irma", "Julia", "Karin", "Linda", "Marta", "Nora", "Olga", "Paula"]
MALE_CYRILLIC = ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Лев"]
FEMALE_CYRILLIC = ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Инна", "Лидия"]
#: Given names that make a name of the capitalised word behind them, beside those above: fixed values.
OTHER_MALE = ["John", "James", "Peter", "Paul", "David", "Michael", "Robert", "Thomas", "William", "Hans", "Klaus", "Jürgen", "Jean", "Pierre", "Jacques", "Juan", "José", "Carlos", "Pablo", "Алексей", "Дмитрий", "Сергей"]
OTHER_FEMALE = ["Mary", "Anna", "Maria", "Jennifer", "Elizabeth", "Susan", "Sarah", "Emma", "Heike", "Sabine", "Ursula", "Claire", "Camille", "Sophie", "Ana", "Isabel", "Lucía", "Ольга", "Мария", "Наталья"]
SYLLABLES = ["ba", "ca", "da", "fa", "ga", "ha", "la", "ma", "be", "ce", "de", "fe", "ge", "le", "me", "ne", "bi", "di", "fi", "li", "mi", "ni", "ri", "si", "bo", "do", "go", "lo", "mo", "no", "ro", "to"]
CYRILLIC_SYLLABLES = ["ба", "ва", "га", "да", "ка", "ла", "ма", "на", "бо", "во", "го", "до", "ко", "ло", "мо", "но"]

_NOT_BEFORE = r"(?<![\p{L}\p{N}_.%+@-])"
_TITLES = "|".join(sorted(MALE_TITLES + FEMALE_TITLES, key=len, reverse=True))
MALE_GIVEN, FEMALE_GIVEN = MALE_NAMES + MALE_CYRILLIC + OTHER_MALE, FEMALE_NAMES + FEMALE_CYRILLIC + OTHER_FEMALE
_GIVEN = "|".join(sorted(MALE_GIVEN + FEMALE_GIVEN, key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": _NOT_BEFORE + r"[\p{L}\p{N}_.%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,64}|gh[ps]_[A-Za-z0-9]{36})(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)(?![\p{{L}}])",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\p{L}\p{N}])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)",
    "ssn": r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\p{L}\d.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\d])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{_GIVEN}) \p{{Lu}}\p{{Ll}}{{1,30}}(?:-\p{{Lu}}\p{{Ll}}{{1,30}})?(?![\p{{L}}\p{{N}}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.? \p{{Lu}}\p{{L}}{{1,30}}(?:[ -]\p{{Lu}}\p{{L}}{{1,30}}){{0,2}}",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity holds; texts without it are passed over.
HINT = rf"[@\d]|(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{_TITLES})\.?|{_GIVEN}) \p{{Lu}}"
LETTERS, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"


def let(x: Column, use) -> Column:
    """use(x) with x worked out once, however often ``use`` names it; it also keeps the plan small."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def kind_of(value: Column) -> Column:
    out = F.lit("name")
    for k in reversed(list(PATTERNS)):
        out = F.when(value.rlike(rf"^(?:{PATTERNS[k]})$"), k).otherwise(out)
    return out


def canonical(value: Column, kind: Column) -> Column:
    """One spelling for the spellings of one entity; a form that ``surrogate`` reads as well."""
    digits = F.regexp_replace(value, r"\D", "")
    code = F.regexp_extract(value, r"^\+(\d{1,3})[ .(-]", 1)
    phone = F.when(code != "", F.concat(F.lit("+"), code, F.lit(" "), F.substr(digits, F.length(code) + 1))).otherwise(digits)
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", phone)
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind == "name", F.concat(F.regexp_extract(value, r"^([^ .]+)", 1), F.lit(" "), F.initcap(F.regexp_extract(value, r"^[^ ]+ (.*)$", 1))))
        .when(kind == "person", F.initcap(value))
        .otherwise(value)
    )


def _digest(key: str, kind: Column, what: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), what), 512)


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substr(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _of(alphabet: str, b: Column) -> Column:
    return F.substr(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))


def _recast(value: Column, digest: Column, hexed: bool = False, keep: Column | None = None) -> Column:
    """Each character replaced by one of its class: digits, letters of the same script and case; the first ``keep`` stay."""

    def drawn(c: Column, b: Column) -> Column:
        low = F.when(c.rlike(r"\p{IsCyrillic}"), _of(CYRILLIC, b)).when(c.rlike(r"\p{IsGreek}"), _of(GREEK, b)).otherwise(_of("abcdef" if hexed else LETTERS, b))
        return F.when(c.rlike(r"\d"), _of("0123456789", b)).when(c.rlike(r"\p{Lu}"), F.upper(low)).when(c.rlike(r"\p{L}"), low).otherwise(c)

    def one(i: Column) -> Column:
        c = F.substr(value, i + 1, F.lit(1))
        # The draw goes by the place among letters and digits, so that separators do not matter.
        place = F.length(F.regexp_replace(F.substr(value, F.lit(1), i), r"[^\p{L}\p{N}]", ""))

        def at_place(at: Column) -> Column:
            new = let(_byte(digest, at), lambda b: drawn(c, b))
            return new if keep is None else F.when(at < keep, c).otherwise(new)

        return let(place, at_place)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1), one), "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def weigh(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), weigh), F.lit(0), lambda a, x: a + x) % 10


def _card(value: Column, digest: Column) -> Column:
    def checked(drawn: Column) -> Column:
        new = F.regexp_replace(drawn, r"\D", "")
        last = F.substr(new, F.length(new), F.lit(1)).cast("int")
        return F.concat(F.left(drawn, F.length(drawn) - 1), ((last + 10 - _luhn(new)) % 10).cast("string"))

    valid = _luhn(F.regexp_replace(value, r"\D", "")) == 0
    return let(_recast(value, digest, keep=F.lit(1)), lambda drawn: F.when(valid, let(drawn, checked)).otherwise(drawn))


def _rest97(plain: Column) -> Column:
    """What an account number, its first four characters moved to the end and letters read as 10 to 35, leaves over 97."""
    moved = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    codes = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.ascii(F.substr(moved, i, F.lit(1))))
    return F.aggregate(codes, F.lit(0), lambda r, c: F.when(c >= 65, (r * 100 + c - 55) % 97).otherwise((r * 10 + c - 48) % 97))


def _iban(value: Column, digest: Column) -> Column:
    """Country and format stay; the check digits are right where those of the original are."""

    def checked(drawn: Column) -> Column:
        open_ = F.concat(F.left(drawn, F.lit(2)), F.lit("00"), F.substr(drawn, F.lit(5)))
        digits = F.lpad((F.lit(98) - _rest97(F.replace(open_, F.lit(" "), F.lit("")))).cast("string"), 2, "0")
        return F.concat(F.left(drawn, F.lit(2)), digits, F.substr(drawn, F.lit(5)))

    valid = _rest97(F.replace(value, F.lit(" "), F.lit(""))) == 1
    return let(_recast(value, digest, keep=F.lit(2)), lambda drawn: F.when(valid, checked(drawn)).otherwise(drawn))


def _ip(value: Column, digest: Column) -> Column:
    part = F.split(value, r"\.")
    first, second = F.get(part, F.lit(0)), F.get(part, F.lit(1))
    draw = lambda k: (F.lit(1) + _byte(digest, F.lit(k)) % 254).cast("string")
    public = (F.lit(11) + _byte(digest, F.lit(0)) % 100).cast("string")
    own = first.isin("10", "127")
    pair = ((first == "192") & (second == "168")) | ((first == "172") & F.try_to_number(second, F.lit("999")).between(16, 31))
    return F.concat_ws(".", F.when(own | pair, first).otherwise(public), F.when(pair, second).otherwise(draw(1)), draw(2), draw(3))


def _name(value: Column, kind: Column, key: str, attempt: Column) -> Column:
    """A title stays; a name before another is a given name of the gender of the title, or of itself, the last one a surname.

    Tokens are drawn by their lower-cased form, so that one person's name in capitals and without is the same.
    """
    head = F.when(kind == "name", F.regexp_extract(value, r"^([^ ]+ )", 1)).otherwise("")
    rest = F.substr(value, F.length(head) + 1)
    tokens = F.regexp_extract_all(rest, F.lit(r"\p{L}+"), F.lit(0))
    first_word = F.regexp_extract(value, r"^([^ .]+)", 1)
    male = F.when(kind == "name", first_word.isin(*MALE_TITLES)).otherwise(first_word.isin(*MALE_GIVEN))

    def pick(names: list[str], b: Column) -> Column:
        return F.get(F.array(*[F.lit(n) for n in names]), b % len(names))

    def drawn(t: Column, given: Column, d: Column) -> Column:
        slavic = t.rlike(r"\p{IsCyrillic}")
        b = _byte(d, F.lit(0))
        first = F.when(male & slavic, pick(MALE_CYRILLIC, b)).when(slavic, pick(FEMALE_CYRILLIC, b)).when(male, pick(MALE_NAMES, b)).otherwise(pick(FEMALE_NAMES, b))
        made = lambda syllables: F.initcap(F.concat(*[pick(syllables, _byte(d, F.lit(k))) for k in range(1, 5)]))
        last = F.when(slavic, made(CYRILLIC_SYLLABLES)).otherwise(made(SYLLABLES))
        return let(F.when(given, first).otherwise(last), lambda new: F.when(t == F.upper(t), F.upper(new)).otherwise(new))

    def one(t: Column, i: Column) -> Column:
        given = (F.size(tokens) > 1) & (i == 0)
        return let(_digest(key, F.when(~given, "surname").when(male, "given-m").otherwise("given-f"), F.lower(t), attempt), lambda d: drawn(t, given, d))

    between = F.concat(F.regexp_extract_all(rest, F.lit("[ -]"), F.lit(0)), F.array(F.lit("")))
    return F.concat(head, F.array_join(F.zip_with(F.transform(tokens, one), between, lambda t, b: F.concat(t, b)), ""))


def surrogate(value: Column, kind: Column, key: str, attempt_of) -> Column:
    """The surrogate of one spelling of an entity; attempt_of(kind, canonical form) numbers the draw."""
    domain = F.substring_index(value, "@", -1)
    ending = F.substring_index(domain, ".", -1)
    hosts = F.lower(F.left(domain, F.length(domain) - F.length(ending)))
    prefix = F.length(F.regexp_replace(F.regexp_extract(value, r"^(AKIA|sk-|gh[ps]_)", 1), r"[^\p{L}\p{N}]", ""))
    plain_hex = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    code = F.length(F.regexp_extract(value, r"^\+(\d{1,3})[ .(-]", 1))

    def drawn(d: Column, attempt: Column) -> Column:
        renamed = let(_digest(key, F.lit("domain"), F.lower(domain), attempt), lambda e: _recast(hosts, e))
        return (
            F.when(kind == "email", F.concat(_recast(F.substring_index(value, "@", 1), d), F.lit("@"), renamed, ending))
            .when((kind == "secret") & plain_hex, _recast(value, d, hexed=True))
            .when(kind == "secret", _recast(value, d, keep=prefix))
            .when(kind == "ip", _ip(value, d))
            .when(kind == "phone", _recast(value, d, keep=F.when(value.startswith("+"), F.greatest(code, F.lit(1))).otherwise(0)))
            .when(kind == "card", _card(value, d))
            .when(kind == "iban", _iban(value, d))
            .when(kind.isin("name", "person"), _name(value, kind, key, attempt))
            .otherwise(_recast(value, d))
        )

    def numbered(canon: Column) -> Column:
        return let(attempt_of(kind, canon), lambda a: let(_digest(key, kind, canon, a), lambda d: drawn(d, a)))

    return let(canonical(value, kind), numbered)


def entities(t: Column) -> Column:
    """The entities of a text in order, repeats included."""
    none = F.array().cast("array<string>")
    return F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0))).otherwise(none)


def redraws(docs: DataFrame, key: str, text: str = "text", max_rounds: int = 50) -> DataFrame | None:
    """(kind, canon, attempt) of the entities whose first draws collide, or None if none does."""
    v = docs.select(F.explode(F.array_distinct(entities(F.col(f"`{text}`")))).alias("v")).distinct()
    v = v.withColumn("kind", kind_of(F.col("v"))).select("kind", canonical(F.col("v"), F.col("kind")).alias("canon")).distinct()
    known = materialize(v, "entities")
    fixed, open_, out = None, known, None
    for attempt in range(max_rounds):
        raw = surrogate(F.col("canon"), F.col("kind"), key, lambda kind, canon: F.lit(attempt))  # noqa: B023
        drawn = materialize(open_.withColumn("s", let(raw, lambda r: canonical(r, F.col("kind")))), "drawn")
        firsts = drawn.groupBy("kind", "s").agg(F.min("canon").alias("canon"))
        won = drawn.join(firsts, ["kind", "s", "canon"])
        won = won.join(known.select("kind", F.col("canon").alias("s")), ["kind", "s"], "left_anti")
        if fixed is not None:
            won = won.join(fixed.select("kind", "s"), ["kind", "s"], "left_anti")
        won = materialize(won.select("kind", "s", "canon"), "won")
        lost = materialize(drawn.select("kind", "canon").join(won, ["kind", "canon"], "left_anti"), "lost")
        if attempt:
            mine = won.select("kind", "canon", F.lit(attempt).alias("attempt"))
            out = mine if out is None else out.unionByName(mine)
        release(drawn)
        if lost.isEmpty():
            release(known), release(lost)
            return out
        fixed = won if fixed is None else fixed.unionByName(won)
        open_ = lost
    raise RuntimeError(f"surrogates still collide after {max_rounds} draws")


def replace_entities(docs: DataFrame, key: str, text: str = "text", counts: bool = False) -> DataFrame:
    """docs with surrogates in the text; with counts also ``n_entities``."""
    if not key:
        raise ValueError("surrogates need a key")
    names = [F.col(f"`{c}`") for c in docs.columns]
    n, found, later_map, row, known_as = free_names(docs.columns, "n_entities", "found", "later", "row", "known_as")
    t = F.col(f"`{text}`")
    later = redraws(docs, key, text)
    rows = docs.withColumn(found, entities(t))
    attempt_of = lambda kind, canon: F.lit(0)
    if later is not None:
        # Only documents with an entity that drew again get the map of the later draws; rows are known by a digest.
        rows = rows.withColumn(row, F.when(F.size(found) > 0, F.sha2(t, 256)))
        each = rows.filter(F.col(row).isNotNull()).select(F.col(row).alias("row"), F.explode(F.array_distinct(found)).alias("v")).withColumn("kind", kind_of(F.col("v")))
        each = each.select("row", "kind", canonical(F.col("v"), F.col("kind")).alias("canon")).join(later, ["kind", "canon"])
        maps = each.groupBy(F.col("row").alias(known_as)).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "canon"), "attempt"))).alias(later_map))
        maps = materialize(maps, "later")
        rows = rows.join(maps, F.col(row) == F.col(known_as), "left")
        attempt_of = lambda kind, canon: F.coalesce(F.try_element_at(later_map, F.concat_ws("\x1f", kind, canon)), F.lit(0))

    def swap(v: Column) -> Column:
        return let(kind_of(v), lambda k: surrogate(v, k, key, attempt_of))

    new = F.transform(F.col(found), swap)
    joined = F.array_join(F.zip_with(F.split(t, ENTITY, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    rows = rows.withColumn(text, F.when(F.size(found) > 0, joined).otherwise(t))
    if counts:
        return rows.select(*names, F.size(found).alias(n))
    return rows.select(*names)
