"""Text expressions as native Columns: cleaning, accent folding, slugs, ids, prices, categories, tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """White space runs, Unicode ones too, become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their base letters, from the Unicode tables."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", ch.lower()) if unicodedata.category(x) != "Mn")
        base = base.replace("đ", "d")
        if len(base) == 1 and base != ch and ch == ch.lower():
            pairs[ch] = base
    return "".join(pairs), "".join(pairs.values())


def fold(c: Column) -> Column:
    """Cleaned, lower-cased, without accents; đ becomes d."""
    return F.regexp_replace(F.translate(F.lower(clean(c)), *_folding()), r"\p{Mn}+", "")


def slug(name: Column, url: Column) -> Column:
    """Folded name with dashes, at most 180 characters, and eight digits of the URL's hash."""
    base = F.regexp_replace(F.regexp_replace(fold(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.regexp_replace(F.substring(base, 1, 180), "-+$", ""), F.lit("-"), F.substring(F.sha2(url, 256), 1, 8))


def product_id(source: Column, url: Column) -> Column:
    return F.concat(source, F.lit(":"), F.substring(F.sha2(url, 256), 1, 16))


def index_id(c: Column) -> Column:
    return F.translate(c, ":", "_")


def price_digits(c: Column) -> Column:
    """Digits without separators as a long; negative or other text gives null."""
    n = F.regexp_replace(c, r"[,.\s]", "").try_cast("long")
    return F.when(n >= 0, n)


def price_in_text(c: Column) -> Column:
    """First price with a currency mark, else the text if it is a number alone."""
    marked = F.regexp_extract(c, r"(?iu)(?<!\d)(\d{1,3}(?:[.\s,]\d{3})+|\d{4,})\s*(?:₫|đ|vnd)", 1)
    alone = F.regexp_extract(clean(c), r"^(\d[\d.,\s]*)$", 1)
    return price_digits(F.when(marked != "", marked).when(alone != "", alone))


def warranty_months(c: Column) -> Column:
    """A plain number, else the number before the word for month."""
    number = F.trim(c).try_cast("int")
    return F.coalesce(number, F.nullif(F.regexp_extract(c, r"(?iu)(\d+)\s*tháng", 1), F.lit("")).try_cast("int"))


def timestamp(c: Column) -> Column:
    """ISO 8601 with or without an offset (none: session time zone UTC); invalid text gives null."""
    return F.regexp_replace(F.trim(c), r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")


def number(c: Column) -> Column:
    """Number without commas and spaces, null for other text."""
    return F.nullif(F.regexp_replace(c, r"[,\s]", ""), F.lit("")).try_cast("double")


def first_number(c: Column) -> Column:
    """First number of a text; a decimal comma is accepted."""
    return F.nullif(F.translate(F.regexp_extract(clean(c), r"(-?\d+(?:[.,]\d+)?)", 1), ",", "."), F.lit("")).try_cast("double")


def all_numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(clean(c), F.lit(r"(-?\d+(?:[.,]\d+)?)"), 1), lambda x: F.translate(x, ",", ".").try_cast("double"))


def has_any(c: Column, *phrases: str) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in phrases])


#: Phrases of stock states on pages, folded.
OUT_OF_STOCK, CONTACT, IN_STOCK = ["het hang", "tam het hang"], ["lien he"], ["con hang", "san hang"]


def stock_phrase(c: Column) -> Column:
    """out_of_stock before contact (unless a phrase says in stock) before in_stock; else unknown."""
    t = fold(c)
    return F.when(has_any(t, *OUT_OF_STOCK), "out_of_stock").when(has_any(t, *CONTACT) & ~t.contains("con hang"), "contact").when(has_any(t, *IN_STOCK), "in_stock").otherwise("unknown")


# Folded phrases by category, in order of precedence.
CATEGORY_HINTS = {
    "cpu": ["cpu intel", "cpu amd", "bo vi xu ly", "processor", "core i3", "core i5", "core i7", "core i9", "core ultra", "ryzen 3", "ryzen 5", "ryzen 7", "ryzen 9"],
    "mainboard": ["mainboard", "bo mach chu", "motherboard"],
    "ram": ["ram desktop", "ram pc", "bo nho ram", "memory desktop"],
    "gpu": ["vga", "card man hinh", "graphics card", "geforce rtx", "radeon rx"],
    "ssd": ["ssd", "o cung the ran", "solid state drive", "nvme"],
    "hdd": ["hdd", "o cung hdd", "hard drive"],
    "psu": ["nguon may tinh", "power supply", " psu "],
    "case": ["vo case", "case may tinh", "computer case"],
    "cooler": ["tan nhiet cpu", "cooler cpu", "aio", "tan nhiet nuoc", "tan nhiet khi"],
    "case_fan": ["fan case", "quat case", "quat tan nhiet"],
    "monitor": ["man hinh may tinh", "monitor"],
    "keyboard": ["ban phim", "keyboard"],
    "mouse": ["chuot may tinh", "gaming mouse", "mouse"],
    "headset": ["tai nghe", "headset", "headphone"],
    "webcam": ["webcam"],
    "laptop": ["laptop", "notebook", "macbook"],
    "desktop_pc": ["pc gaming", "pc van phong", "pc do hoa", "may tinh de ban", "desktop pc", "workstation"],
    "ups": ["bo luu dien", "ups"],
}


def category(c: Column, hints: dict[str, list[str]] = CATEGORY_HINTS) -> Column:
    """First category with a phrase in the folded text, else other."""
    t = fold(c)
    return F.coalesce(*[F.when(has_any(t, *words), name) for name, words in hints.items()], F.lit("other"))


# Units that a specification key may end with, longest first, and plural forms.
UNITS = ["gbps", "mbps", "inch", "w_h", "ghz", "mhz", "fps", "dpi", "rpm", "gb", "mb", "tb", "mm", "cm", "kg", "mp", "hz", "w", "g", "°"]
PLURALS = {"inches": "inch", "mbs": "mb", "gbs": "gb", "tbs": "tb", "mgs": "mg", "kgs": "kg"}


def unit(key: Column) -> Column:
    k = F.lower(key)
    known = [F.when(k.endswith(u), u) for u in UNITS]
    plural = [F.when(k.endswith("_" + p) | (k == p), u) for p, u in PLURALS.items()]
    return F.coalesce(*known, *plural)


# Group of each specification key; other keys belong to group other.
GROUPS = {
    "cpu": ["cpu", "cpu_model", "cpu_cores", "cpu_threads", "cpu_base_clock_ghz", "cpu_boost_clock_ghz", "socket"],
    "ram": ["ram", "ram_gb", "ram_type", "ram_speed_mhz", "max_ram_gb", "ram_slots", "ram_standard"],
    "storage": ["storage", "storage_gb", "storage_type", "storage_detail", "upgrade_storage_options"],
    "gpu": ["gpu", "gpu_model", "gpu_vram_gb", "gpu_vram_type"],
    "screen": ["screen", "screen_inches", "resolution_label", "resolution_width", "resolution_height", "refresh_rate_hz", "panel_type"],
    "connectivity": ["connectivity"],
    "warranty": ["warranty", "warranty_months"],
    "os": ["os"],
    "ports": ["ports"],
}


def group_of(key: Column) -> Column:
    return F.coalesce(*[F.when(key.isin(*keys), g) for g, keys in GROUPS.items()], F.lit("other"))


def money(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.translate(F.format_number(c, 0), ",", "."), F.lit(" ₫"))).otherwise("Liên hệ")


def stock_text(c: Column) -> Column:
    return F.when(c == "in_stock", "Còn hàng").when(c == "out_of_stock", "Hết hàng").otherwise("Liên hệ")


def tokens_estimate(c: Column) -> Column:
    return F.floor(F.char_length(c) / 4).cast("long")


def cut_chunk(c: Column, tokens: int = 500) -> Column:
    return F.substring(c, 1, 4 * tokens)


def words(c: Column) -> Column:
    """Folded words of letters and digits."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: A word, a number (with one or two decimals) or a sign, each with the space before it.
PIECE = r" ?(?:\p{L}+|(?<!\d)\d{1,3}[.,]\d{1,2}(?!\d)|\d+|[^\p{L}\d ])"


class Pieces:
    """The words, numbers and signs of a text by place, upper-cased to compare and as they stand to quote."""

    def __init__(self, both: Column):
        self.raw, self.key = both["raw"], both["key"]

    def at(self, place: Column) -> Column:
        return F.get(self.key, place)

    def glued(self, place: Column) -> Column:
        """Whether nothing parts the piece from the one before."""
        return ~F.get(self.raw, place).startswith(" ")

    def digits(self, place: Column, least: int, most: int) -> Column:
        return F.regexp_like(self.at(place), F.lit(r"^\d+$")) & F.length(self.at(place)).between(least, most)

    def number(self, place: Column) -> Column:
        return F.translate(self.at(place), ",", ".").try_cast("double")

    def all(self, test: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
        """``value`` of every place that passes ``test``, in order."""
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(self.key)), test), value)

    def first(self, test: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
        return F.get(self.all(test, value), F.lit(0))

    def run(self, place: Column) -> Column:
        """Where the piece at ``place`` and the words, numbers and dashes glued to it end."""
        on = lambda k: self.glued(k) & (F.regexp_like(self.at(k), F.lit(r"^[\p{L}\d]+$")) | (self.at(k) == "-"))
        return self.first(lambda k: (k > place) & ~F.coalesce(on(k), F.lit(False)), lambda k: k)

    def quote(self, start: Column, end: Column) -> Column:
        return F.trim(F.array_join(F.slice(self.raw, start + 1, end - start), ""))


def by_pieces(c: Column, body: Callable[[Pieces], Column]) -> Column:
    """``body`` over the pieces of ``c``, which are made once; null for null."""
    raw = F.regexp_extract_all(clean(c), F.lit(PIECE), F.lit(0))
    keyed = F.transform(F.array(raw), lambda r: F.struct(r.alias("raw"), F.transform(r, lambda x: F.upper(F.trim(x))).alias("key")))
    return F.when(c.isNotNull(), F.get(F.transform(keyed, lambda v: body(Pieces(v))), F.lit(0)))


def _intel(p: Pieces) -> Column:
    """Tier, number and letters of a processor written i5-12400F or i5 12400F."""
    number = lambda i: F.when(p.at(i + 2) == "-", i + 3).otherwise(i + 2)
    test = lambda i: (p.at(i) == "I") & p.at(i + 1).isin("3", "5", "7", "9") & p.glued(i + 1) & p.digits(number(i), 4, 5)
    return p.first(test, lambda i: F.struct(p.at(i + 1).alias("tier"), _coded(p, number(i)).alias("number")))


def _ryzen(p: Pieces) -> Column:
    test = lambda i: (p.at(i) == "RYZEN") & p.at(i + 1).isin("3", "5", "7", "9") & p.digits(i + 2, 4, 5)
    return p.first(test, lambda i: F.struct(p.at(i + 1).alias("tier"), _coded(p, i + 2).alias("number")))


def _coded(p: Pieces, place: Column) -> Column:
    """A number and the letters glued to it, in small letters."""
    letters = F.when(p.glued(place + 1) & F.regexp_like(p.at(place + 1), F.lit(r"^\p{L}+$")), p.at(place + 1))
    return F.lower(F.concat(p.at(place), F.coalesce(letters, F.lit(""))))


def _card(p: Pieces) -> Column:
    test = lambda i: p.at(i).isin("RTX", "GTX", "RX") & p.digits(i + 1, 3, 4)
    return p.first(test, lambda i: F.struct(F.lower(p.at(i)).alias("line"), p.at(i + 1).alias("number"), F.when(p.at(i + 2) == "TI", "ti").alias("ti")))


def alias_tokens(cpu: Column, gpu: Column, ram_gb: Column, ram_type: Column, storage_gb: Column, storage_type: Column, inches: Column, hz: Column, *texts: Column) -> Column:
    """Ordered distinct search forms of a product: model names spaced and compact, sizes with units, unaccented ``texts``.

    A form that lacks a part is null and left out.
    """
    number = lambda c: F.nullif(c, F.lit(0))
    join = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    intel, ryzen, card = by_pieces(cpu, _intel), by_pieces(cpu, _ryzen), by_pieces(gpu, _card)
    ram, disk, rate = (number(c) for c in (ram_gb, storage_gb, hz))
    kind = F.when(ram.isNotNull(), F.nullif(F.lower(ram_type), F.lit("")))
    size = F.when(inches != 0, F.regexp_replace(inches.cast("string"), r"\.?0*$", ""))
    forms = [join("i", intel["tier"], sign, intel["number"]) for sign in ("-", " ", "")]
    forms += [join(line, ryzen["tier"], " ", ryzen["number"]) for line in ("ryzen ", "r")]
    forms += [F.when(card["line"].isNotNull(), F.concat_ws(sign, card["line"], card["number"], card["ti"])) for sign in (" ", "")]
    forms += [join(card["number"], " ", card["ti"])]
    for value in (ram, disk):
        forms += [join(value.cast("string"), "gb"), join(value.cast("string"), " gb")]
        if value is ram:
            forms += [kind, join(ram.cast("string"), "gb ", kind)]
    forms += [F.when(F.lower(storage_type).contains("ssd"), join("ssd", disk.cast("string")))]
    forms += [F.when((disk >= 1024) & (disk % 1024 == 0), join((disk / 1024).cast("int").cast("string"), "tb"))]
    forms += [join(size, " inch"), join(size, "inch"), join(rate.cast("string"), "hz"), join(rate.cast("string"), " hz")]
    forms += [F.when(fold(t) != F.lower(t), fold(t)) for t in texts]
    return F.array_distinct(F.array_compact(F.array(*forms)))


def spec_summary(cpu: Column, ram_gb: Column, ram_type: Column, storage_gb: Column, storage_type: Column, gpu: Column, inches: Column, hz: Column) -> Column:
    """Short line "cpu / ram / storage / gpu / screen"; missing parts (also 0 and empty) are left out."""
    some = lambda c: c.isNotNull() & (c != 0)
    ram = F.when(some(ram_gb), F.concat_ws(" ", F.concat(ram_gb.cast("string"), F.lit("GB")), F.nullif(ram_type, F.lit(""))))
    disk = F.when(some(storage_gb), F.concat(F.coalesce(F.nullif(storage_type, F.lit("")), F.lit("Storage")), F.lit(" "), storage_gb.cast("string"), F.lit("GB")))
    screen = F.when(some(inches), F.concat_ws(" ", F.concat(inches.cast("string"), F.lit(" inch")), F.when(some(hz), F.concat(hz.cast("string"), F.lit("Hz")))))
    return F.concat_ws(" / ", F.nullif(cpu, F.lit("")), ram, disk, F.nullif(gpu, F.lit("")), screen)


def breadcrumbs(raw: Column) -> Column:
    """JSON array of strings or of objects (name, label or title) to trimmed, non-empty strings."""
    items = F.from_json(raw, "array<string>")
    name = lambda x: F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.name"), F.get_json_object(x, "$.label"), F.get_json_object(x, "$.title"))).otherwise(x)
    return F.filter(F.transform(items, lambda x: F.trim(name(x))), lambda x: x.isNotNull() & (x != ""))
