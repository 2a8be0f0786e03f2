"""Personal data: detection and keyed surrogates, with DataFrame functions only.

Detected entities are replaced by values of the same kind and format that depend on a secret key and on the
entity alone, so that all mentions of one entity get one surrogate, in whatever case or punctuation they come.
Distinct entities get distinct surrogates, and none equals an entity of the corpus: candidates are checked
with an aggregate and an anti-join, and those that clash are drawn again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

FEMALE = ["Mrs", "Ms", "Miss", "Mme", "Madame", "Frau", "Señora", "Sra", "Señorita", "госпожа", "г-жа"]
MALE = ["Mr", "Monsieur", "Herr", "Señor", "Sr", "господин", "г-н"]
NEUTRAL = ["Dr", "Prof"]
_TITLE = r"(?<![\p{L}\p{N}-])(?:" + "|".join(FEMALE + MALE + NEUTRAL) + r")\.? "
_NAME = r"\p{Lu}\p{Ll}[\p{L}'’-]*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_IPV6 = rf"(?:{_HEX}(?::{_HEX}){{7}}|(?!(?:[0-9A-Fa-f]*:){{8}})(?=[A-Fa-f:]*\d){_HEX}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)"
_EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"


def _keyed(value: str, start: str) -> str:
    """A secret after its key name: characters of the class ``value``, eight at least, a letter or digit among them, without punctuation at the end."""
    word, marks = rf"[[{value}]&&[^.,;:!?)\]}}>\"']]", rf"[[{value}]&&[.,;:!?)\]}}>\"']]"
    key = r"(?<=(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)"
    return rf"{start}(?=[{value}]{{7}}{marks}*+{word})(?=[{value}]*?[\p{{L}}\p{{N}}]){key}(?:{marks}*+{word}++)++"


#: Kinds in order of precedence. Each pattern starts at a boundary, so that scanning stays linear, and with cheap looks
#: around, so that the long ones are tried at few places.
PATTERNS = {
    "keyed": r"(?<=[=:\s\"'])(?=\S{8})(?<=[=:]\s{0,2}[\"']?)(?:" + "|".join([_keyed(r"^\s\p{Z}\"", r"(?<=\")"), _keyed(r"^\s\p{Z}'", "(?<=')"), _keyed(r"^\s\p{Z}", r"(?<![\"'])(?![\"'])")]) + ")",
    "email": rf"(?<![A-Za-z0-9._%+-]){_EMAIL}(?![A-Za-z0-9])",
    "ip": rf"(?=\d)(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "ipv6": rf"(?={_HEX}:)(?<![\w:.]){_IPV6}(?!\w|:[\w:]|\.\d)",
    "secret": r"(?<![A-Za-z0-9_])(?=[0-9A-Za-z_-]{20})(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}+|[0-9a-f]{32,64}|[0-9A-F]{32,64}"
    r"|(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{65,}+|(?=[0-9]*+[A-F])(?=[A-F]*+[0-9])[0-9A-F]{65,}+)(?![A-Za-z0-9_])",
    "iban": r"(?=[A-Z]{2}\d)(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?=\d)(?<![\w.+-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-]|\.\d)",
    "ssn": r"(?=\d)(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?=[+(\d])(?:(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-]|\.\d))",
    "name": rf"(?=\p{{Lu}})(?:(?<={_TITLE}){_NAME}|(?<={_TITLE}\p{{Lu}}\p{{Ll}}[\p{{L}}'’-]{{0,98}} ){_NAME})",
}
ANY = r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"

# Given names of the surrogates by gender and script, and syllables of their surnames.
GIVEN = {
    ("f", "latin"): "Anna Clara Elena Emma Irene Julia Laura Lucia Maria Nora Paula Rosa Sara Sofia Teresa Vera".split(),
    ("m", "latin"): "Adam Bruno Daniel David Emil Felix Hugo Jonas Leo Lukas Martin Nico Oscar Paul Simon Victor".split(),
    ("f", "cyrillic"): "Анна Вера Елена Ирина Мария Нина Ольга Софья".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Иван Максим Олег Павел Роман".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta te to".split(),
    "cyrillic": "ба бе бо ва ве да де ка ке ко ла ле ма ме мо на не но ра ре ро са се та те то".split(),
}


def kind_of(form: Column) -> Column:
    """Kind of a detected string: the first pattern that its shape fits."""
    return (
        F.when(form.rlike(rf"^{_EMAIL}$"), "email")
        .when(form.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(form.rlike(rf"^{_IPV6}$"), "ipv6")
        .when(form.rlike(r"^\p{Lu}\p{Ll}[\p{L}'’-]*$") & ~form.rlike(r"[0-9]"), "name")
        .when(form.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(form.rlike(r"^[\d ().+-]*(?:\d[ ().+-]*){5}$") & (form.rlike(r"^[(+]") | form.rlike(r"^\d{3}[ .-]\d{3}[ .-]\d{4}$")), "phone")
        .when(form.rlike(r"^\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}$"), "card")
        .when(form.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{1,4})+$") & (F.length(form) <= 42), "iban")
        .otherwise("secret")
    )


def canonical(kind: Column, form: Column) -> Column:
    """What all mentions of an entity have in common."""
    digits = F.regexp_replace(form, r"\D", "")
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(form))
        .when(kind == "phone", F.right(digits, F.lit(10)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.replace(form, F.lit(" "), F.lit("")))
        .otherwise(form)
    )


def _byte(stream: Column, at: Column) -> Column:
    """Number 0 to 65535 at a place of a stream of hex digits that wraps around."""
    return F.conv(F.substring(stream, F.pmod(at * 4, F.lit(120)) + 1, F.lit(4)), 16, 10).cast("int")


def _pick(values: str | list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))) + 1)


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _shaped(text: Column, stream: Column, lower: str = LOWER, upper: str = UPPER, digits: str = DIGITS) -> Column:
    """``text`` with other letters and digits of the same class, small Latin ones for other scripts; other characters stay."""

    def one(c: Column, i: Column) -> Column:
        n = _byte(stream, i) + F.pmod(F.floor(i / 30), F.lit(97)).cast("int")
        return F.when(c.rlike("[a-z]"), _pick(lower, n)).when(c.rlike("[A-Z]"), _pick(upper, n)).when(c.rlike("[0-9]"), _pick(digits, n)).when(c.rlike(r"[\p{L}\p{N}]"), _pick(lower, n)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits; a multiple of ten is valid."""
    parts = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = F.transform(parts, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b)


#: Draws from this one on add more and more digits, so that values of a short shape that is used up get one too.
WIDE = 4


def surrogate(kind: Column, value: Column, key: str, attempt: int) -> Column:
    """Candidate for the entity ``value`` (its canonical form) of ``kind``, which may end in a gender, as name:f."""
    stream = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, F.lit(str(attempt))), 512)
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    plain = _shaped(value, stream)
    head = F.substring(plain, F.lit(1), F.length(plain) - 1)
    check = F.pmod(-luhn_sum(F.concat(head, F.lit("0"))), F.lit(10)).cast("string")
    card = F.when(F.pmod(luhn_sum(value), F.lit(10)) == 0, F.concat(head, check)).otherwise(plain)
    domain = F.substring_index(value, "@", -1)
    top = F.substring_index(domain, ".", -1)
    email = F.concat(_shaped(F.substring(value, F.lit(1), F.length(value) - F.length(top) - 1), stream), F.lit("."), top)
    octets = F.transform(F.split(value, r"\."), lambda c, i: (_byte(stream, i) % 254 + 1).cast("string"))
    secret = (
        F.when(value.rlike("^[0-9a-f]+$"), _shaped(value, stream, LOWER[:6], UPPER[:6], DIGITS))
        .when(value.rlike("^[0-9A-F]+$"), _shaped(value, stream, LOWER[:6], UPPER[:6], DIGITS))
        .otherwise(plain)
    )
    iban = F.concat(F.left(value, F.lit(2)), _shaped(F.substring(value, F.lit(3), F.length(value)), stream))
    given = reduce(lambda rest, k: F.when((kind == f"given:{k[0]}") & (script == k[1]), F.concat(_pick(GIVEN[k], _byte(stream, F.lit(0))), *_tail(k[1], stream, attempt))).otherwise(rest), GIVEN, F.lit(None).cast("string"))
    surname = F.when(script == "cyrillic", _surname("cyrillic", stream, attempt)).otherwise(_surname("latin", stream, attempt))
    drawn = (
        F.when(kind == "email", email)
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "ipv6", _shaped(value, stream, LOWER[:6]))
        .when(kind == "card", card)
        .when(kind.isin("phone", "ssn"), plain)
        .when(kind == "iban", iban)
        .when(kind.startswith("given"), given)
        .when(kind == "surname", surname)
        .otherwise(secret)
    )
    if attempt < WIDE:
        return drawn
    more = F.substring(F.regexp_replace(F.sha2(F.concat(stream, F.lit("more")), 512), "[a-f]", "7"), F.lit(1), F.lit(2 * (attempt - WIDE + 1)))
    named = kind.startswith("given") | (kind == "surname")  # their own tails grow
    return F.when(named, drawn).when(kind == "email", F.concat(more, drawn)).otherwise(F.concat(drawn, more))


def _tail(script: str, stream: Column, attempt: int) -> list[Column]:
    """From the second draw on, a second part keeps given names apart when the list is used up."""
    return [] if attempt < 2 else [F.lit("-"), _surname(script, stream, attempt)]


def _surname(script: str, stream: Column, attempt: int) -> Column:
    parts = [_pick(SYLLABLES[script], _byte(stream, F.lit(k))) for k in range(1, 4 + min(attempt, 4))]
    return F.initcap(F.concat(*parts))


def rendered(kind: Column, form: Column, value: Column) -> Column:
    """The surrogate ``value`` in the case and punctuation of the mention ``form``; digits beyond its length follow it."""
    whole, width = value, F.length(canonical(kind, form))
    value = F.when(kind.isin("phone", "card", "ssn", "iban"), F.left(whole, width)).otherwise(whole)
    more = F.substring(whole, width + 1, F.length(whole))

    def digit(c: Column, i: Column) -> Column:
        left = F.length(F.regexp_replace(F.substring(form, i + 1, F.length(form)), r"\D", ""))
        return F.when(c.rlike(r"\d") & (left <= F.length(value)), F.substring(value, F.length(value) - left + 1, F.lit(1))).otherwise(c)

    def letter(c: Column, i: Column) -> Column:
        left = F.length(F.replace(F.substring(form, i + 1, F.length(form)), F.lit(" "), F.lit("")))
        return F.when(c == " ", c).otherwise(F.substring(value, F.length(value) - left + 1, F.lit(1)))

    chars = F.filter(F.split(form, ""), lambda c: c != "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.concat(F.array_join(F.transform(chars, digit), ""), more))
        .when(kind == "iban", F.concat(F.array_join(F.transform(chars, letter), ""), more))
        .when(kind.isin("email", "ipv6") & (form == F.upper(form)), F.upper(value))
        .otherwise(value)
    )


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row (pos, kind, form) for each entity in column ``text``, in place of that column; pos counts from 0."""
    rest = [c for c in docs.columns if c != text]
    cut = docs.select(*rest, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)).alias("f"), F.split(F.col(text), ANY, -1).alias("g"))
    n = F.size("f")
    zipped = F.arrays_zip(F.col("f").alias("form"), F.slice("g", F.lit(1), n).alias("before"), F.slice("g", F.lit(2), n).alias("after"), F.slice("f", F.lit(2), n).alias("next"))
    rows = cut.select(*rest, F.posexplode(zipped).alias("pos", "m")).select(*rest, "pos", "m.*")
    kind = kind_of(F.col("form"))
    gender = F.when(F.col("before").rlike("(?:" + "|".join(FEMALE) + r")\.? $"), "f").otherwise("m")
    given = F.col("before").rlike(_TITLE + "$") & (F.col("after") == " ") & F.coalesce(kind_of(F.col("next")) == "name", F.lit(False))
    kind = F.when(kind != "name", kind).when(given, F.concat(F.lit("given:"), gender)).otherwise("surname")
    return rows.select(*rest, "pos", kind.alias("kind"), "form")


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct ``entities`` (kind, value): one surrogate each, all different.

    Candidates that equal an entity of the corpus, a surrogate given before or a candidate of a smaller value are drawn
    again. Clashes are rare, so the second round already has few rows. Where a short shape is used up, later draws are longer.
    """
    open_, given, attempt = entities, None, 0
    real = entities.select(F.col("kind").alias("k"), F.col("value").alias("v"))
    while True:
        cand = open_.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), key, attempt))
        first = cand.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        free = first.join(real, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("v")), "left_anti")
        if given is not None:
            free = free.join(given.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        got = written(free.select("kind", "value", "surrogate"))
        given = got if given is None else given.unionByName(got)
        left = open_.join(got, ["kind", "value"], "left_anti")
        if left.isEmpty():
            return given
        open_, attempt = written(left), attempt + 1


def replace(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every entity in column ``text`` replaced by its surrogate; ``count``: adds their number.

    Null and empty texts stay as they are. Repeated rows get the same text. All rows and columns stay, null ids too. Whole
    texts are searched. Kinds: e-mail, IPv4 and IPv6 address, secret, IBAN, card, social security and phone numbers, and names after a
    title. A surname found so is replaced, and counted, wherever it recurs as a whole word in the same text.
    """
    h, p, k, f, s = (free_name(docs, n) for n in ("text_hash", "mentions", "row_id", "surrogates", "surnames"))
    base = docs.withColumn(h, F.xxhash64(text))
    found = base.select(F.col(doc_id).alias("id"), F.col(h).alias("h"), F.col(text).alias("text")).where(F.col("text").rlike(ANY))
    seen = written(mentions(found))
    forms = written(seen.select("kind", "form").distinct().withColumn("value", canonical(F.col("kind"), F.col("form"))))
    values = written(forms.select("kind", "value").distinct())
    table = forms.join(distinct_surrogates(values, key), ["kind", "value"]).select("kind", "form", rendered(F.col("kind"), F.col("form"), F.col("surrogate")).alias("new"))
    surname = F.when(F.col("kind") == "surname", F.struct((-F.length("form")).alias("order"), "form", "new"))
    by_doc = seen.join(written(table), ["kind", "form"]).groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("pos", "new"))).alias("s"), F.sort_array(F.collect_set(surname)).alias("names"))
    by_doc = by_doc.select(F.col("id").alias(k), F.col("h").alias(p), F.col("s.new").alias(f), F.col("names").alias(s))
    joined = base.join(by_doc, base[doc_id].eqNullSafe(F.col(k)) & (base[h] == F.col(p)), "left")
    gaps = F.split(F.col(text), ANY, -1)

    def whole_word(name: Column) -> Column:
        return F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), name["form"], F.lit(r"\E(?![\p{L}\p{N}])"))

    def again(gap: Column) -> Column:
        return F.aggregate(F.col(s), gap, lambda t, name: F.regexp_replace(t, whole_word(name), name["new"]))

    whole = F.when(F.size(s) > 0, F.transform(gaps, again)).otherwise(gaps)
    rebuilt = F.array_join(F.zip_with(whole, F.col(f), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    cols = [F.when(F.col(f).isNull(), F.col(text)).otherwise(rebuilt).alias(text) if c == text else F.col(c) for c in docs.columns]
    if count:
        step = lambda n, gap: n + F.aggregate(F.col(s), F.lit(0), lambda m, name: m + F.size(F.regexp_extract_all(gap, whole_word(name), F.lit(0))))
        recurring = F.when(F.size(s) > 0, F.aggregate(gaps, F.lit(0), step)).otherwise(0)
        cols.append(F.coalesce(F.size(f) + recurring, F.lit(0)).cast("long").alias(count))
    return joined.select(*cols)


#: Key of the registered query; a deployment passes its own secret.
QUERY_KEY = "surrogates of the registered query"


def report(docs: DataFrame, key: str = QUERY_KEY) -> DataFrame:
    """doc_id, n_entities, text with surrogates."""
    return replace(docs.select("doc_id", "text"), key, count="n_entities").select("doc_id", "n_entities", "text")
