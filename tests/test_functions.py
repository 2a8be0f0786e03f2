"""Expressions on inline values."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from wareflow.functions import security, specs, text, urls


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (text.clean, "  a   b\n", "a b"),
        (text.fold, " Máy  TÍNH Đẹp ", "may tinh dep"),
        (text.price_digits, "1.234.000", 1234000),
        (text.price_digits, "-5", None),
        (text.price_digits, "lien he", None),
        (text.price_in_text, "Giá: 12.990.000 ₫ (VAT)", 12990000),
        (text.price_in_text, "bao 12 vnd", None),
        (text.warranty_months, "Bảo hành 24 THÁNG", 24),
        (text.warranty_months, "0 tháng", 0),
        (text.warranty_months, "một năm", None),
        (text.first_number, "dài 2,5 m", 2.5),
        (text.number, "1,234", 1234.0),
        (text.number, "12 GB", None),
        (text.stock_phrase, "Tạm hết hàng, liên hệ", "out_of_stock"),
        (text.stock_phrase, "Liên hệ", "contact"),
        (text.stock_phrase, "Còn hàng - liên hệ", "in_stock"),
        (text.stock_phrase, "?", "unknown"),
        (text.category, "Bộ vi xử lý Intel", "cpu"),
        (text.category, "Card màn hình RTX", "gpu"),
        (text.category, "ghế", "other"),
        (text.unit, "ram_gb", "gb"),
        (text.unit, "screen_inches", "inch"),
        (text.unit, "cpu_base_clock_ghz", "ghz"),
        (text.unit, "ports", None),
        (text.group_of, "socket", "cpu"),
        (text.group_of, "x", "other"),
        (text.index_id, "shop:1", "shop_1"),
        (specs.capacity_gb, "1TB", 1024),
        (specs.capacity_gb, "512 mb", 0),
        (specs.capacity_gb, "16GB (2x8GB)", 16),
        (specs.module_count, "16GB (2x8GB)", 2),
        (specs.gpu_model, "Asus rtx 4070  ti super", "RTX 4070 TI"),
        (specs.cpu_model, "PC Intel Core i5-12400F, 16GB", "Intel Core i5-12400F"),
        (specs.vram_gb, "RTX 3060, 12GB", 12),
        (specs.wattage, "750W, peak 850 W", 850),
        (specs.radiators, "360mm / 240 mm / 360 mm", [240, 360]),
        (specs.form_factors, "E-ATX, mATX", ["E-ATX", "ATX", "Micro-ATX"]),
        (specs.ports, "2x HDMI, usb-c", ["HDMI", "USB-C"]),
        (specs.yes_no, "Không", False),
        (specs.yes_no, "Có", True),
        (specs.weight_kg, "950 g", 0.95),
        (specs.socket, "Socket lga 1700", "LGA1700"),
        (specs.max_ghz, "3.5GHz up to 4,9 GHz", 4.9),
        (specs.ssd_interface, "PCIe Gen 4", "PCIe 4.0"),
        (specs.split_list, "a; b|c,, ", ["a", "b", "c"]),
        (urls.canonical, "http://Shop.Example//a//b.html?utm_source=x&k=&b=2#f", "https://shop.example/a/b.html?k=&b=2"),
        (urls.is_product_page, "https://x.y/abc.html", True),
        (urls.is_product_page, "https://x.y/abc_dm12.html", False),
        (urls.is_product_page, "https://x.y/abc.html-2", False),
        (urls.is_product_sitemap, "https://x.y/sitemap_pc3.xml", True),
        (security.mask, "gọi 0912345678 hoặc a.b@c.vn sk-ABCDEFGHIJKLMNOP1", "gọi [REDACTED] hoặc [REDACTED] [REDACTED]"),
    ],
)
def test_value(spark, make, value, want):
    got = one(spark, make, value)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_nulls_give_null(spark):
    df = spark.createDataFrame([(None,)], "c string")
    c = F.col("c")
    assert df.select(*[f(c).alias(f"a{i}") for i, f in enumerate((text.clean, text.fold, text.price_digits, specs.capacity_gb, urls.canonical, security.mask))]).first() == (None,) * 6


def test_ids_and_slug(spark):
    url = "https://shop.example/x.html"
    digest = hashlib.sha256(url.encode()).hexdigest()
    assert one(spark, lambda u: text.product_id(F.lit("s"), u), url) == f"s:{digest[:16]}"
    assert one(spark, text.slug, "Máy Tính  Để Bàn!", url) == f"may-tinh-de-ban-{digest[:8]}"
    long = one(spark, text.slug, "ab " * 100, url)
    assert len(long) <= 189 and "--" not in long


def test_timestamp(spark):
    got = lambda v: str(one(spark, text.timestamp, v))
    assert got("2024-05-01T10:00:00+0700") == "2024-05-01 03:00:00"
    assert got("2024-05-01T10:00:00") == "2024-05-01 10:00:00"
    assert got("yesterday") == "None"


def test_hmac_equals_python(spark):
    for key in ("salt:v1", "k" * 100):
        want = hmac.new(key.encode(), "người dùng".encode(), hashlib.sha256).hexdigest()
        assert one(spark, lambda c, k=key: security.hmac_sha256(k, c), "người dùng") == want


def test_price_state_json(spark):
    df = spark.createDataFrame([(5, None, "còn")], "p long, n int, s string")
    none = F.lit(None).cast("long")
    text_ = '{"build_pc_price_vnd":null,"list_price_vnd":null,"price_vnd":5,"regional_price_vnd":null,"sale_price_vnd":null,"stock_quantity":null,"stock_status":"còn"}'
    assert df.select(security.price_state_hash(F.col("p"), none, none, none, none, F.col("s"), F.col("n"))).first()[0] == hashlib.sha256(text_.encode()).hexdigest()


def test_alias_tokens_and_summary(spark):
    df = spark.createDataFrame([("Intel Core i5-12400F", "GeForce RTX 3060 Ti", 16, "DDR4", 1024, "SSD NVMe", 15.6, 144, "Máy chơi game")], "cpu string, gpu string, ram int, rt string, st int, sty string, inch double, hz int, name string")
    cols = [F.col(c) for c in df.columns]
    got = df.select(text.alias_tokens(*cols).alias("x")).first().x
    for token in ["i5-12400f", "i5 12400f", "i512400f", "rtx 3060 ti", "rtx3060ti", "3060 ti", "16gb ddr4", "ssd1024", "1tb", "15.6 inch", "144hz", "may choi game"]:
        assert token in got
    line = df.select(text.spec_summary(F.col("cpu"), F.col("ram"), F.col("rt"), F.col("st"), F.col("sty"), F.col("gpu"), F.col("inch"), F.col("hz"))).first()[0]
    assert line == "Intel Core i5-12400F / 16GB DDR4 / SSD NVMe 1024GB / GeForce RTX 3060 Ti / 15.6 inch 144Hz"


def test_spec_rules_by_category(spark):
    rows = [
        ("cpu", "AMD Ryzen 5 5600", [("Socket", "AM4"), ("Số nhân", "6"), ("Số luồng", "12")]),
        ("ram", "Kingston 16GB (2x8GB) DDR4 3200MHz", []),
        ("monitor", "LG 27 inch IPS 144Hz", [("Độ phân giải", "2560 x 1440")]),
        ("psu", "Corsair 750W 80 Plus Gold Full Modular", []),
        ("chair", "Ghế", []),
    ]
    df = spark.createDataFrame([(c, n, [{"key": k, "value": v} for k, v in p]) for c, n, p in rows], "category string, name string, raw array<struct<key: string, value: string>>")
    norm = specs.spec_map(F.col("category"), F.col("pairs"), F.col("name"))
    df = df.withColumn("pairs", specs.folded_pairs(F.col("raw"))).withColumn("m", norm)
    got = {r.category: r for r in df.select("category", "m", specs.spec_status(F.col("category"), F.col("m"), F.size("raw")).alias("s")).collect()}
    assert got["cpu"].m["manufacturer"] == "AMD" and got["cpu"].m["cores"] == "6" and got["cpu"].s.status == "ok"
    assert got["ram"].m["capacity_per_module_gb"] == "8" and got["ram"].m["speed_mhz"] == "3200"
    assert got["monitor"].m["resolution_label"] == "2K" and got["monitor"].m["screen_inches"] == "27.0"
    assert got["psu"].m["wattage_w"] == "750" and got["psu"].m["modular_type"] == "full_modular"
    assert got["chair"].m == {} and got["chair"].s.status == "missing"


def test_hardware_readers(spark):
    cases = [
        (specs.socket, "Socket lga 1700", "LGA1700"),
        (specs.socket, "AM4", "AM4"),
        (specs.socket, "AM45 board", None),
        (specs.sockets, "LGA1700, LGA 1200 / AM5, AM5 sTRX4 TR4", ["LGA1700", "LGA1200", "AM5", "TR4"]),
        (specs.chipset, "ASUS PRIME B660M-A D4", "B660M"),
        (specs.chipset, "Mainboard Z790 ATX", "Z790"),
        (specs.chipset, "XB660 no", None),
        (specs.chipset, "B6600", None),
        (specs.ram_type, "8GB lpddr5 6400", "LPDDR5"),
        (specs.ram_type, "GDDR6", None),
        (specs.module_count, "2 x 8 GB kit", 2),
        (specs.module_count, "16GB", None),
        (specs.max_ghz, "2,5 GHz boost 4.9GHz", 4.9),
        (specs.gpu_model, "MSI RTX4070 Super 12GB", "RTX4070 SUPER"),
        (specs.gpu_model, "GTX 1650 4GB, RX 6600 XT", "GTX 1650"),
        (specs.gpu_model, "Radeon rx 6600 XT", "RX 6600 XT"),
        (specs.gpu_model, "Intel Arc A770 16GB", "ARC A770"),
        (specs.gpu_model, "RTX Studio", None),
        (specs.cpu_model, "Laptop Intel Core Ultra 7 155H 16GB", "Intel Core Ultra 7 155H"),
        (specs.cpu_model, "Intel Core 5 120U", "Intel Core 5 120U"),
        (specs.cpu_model, "CPU AMD Ryzen 5 5600X (6 nhân)", "AMD Ryzen 5 5600X"),
        (specs.cpu_model, "ryzen 7 7800X3D", "ryzen 7 7800X3D"),
        (specs.cpu_model, "Core i5", None),
        (specs.vram_gb, "GDDR6X: 10GB", 10),
        (specs.vram_gb, "VRAM 8 GB", 8),
        (specs.vram_gb, "RTX 3060 Ti Gaming OC 8GB", 8),
        (specs.vram_gb, "RTX 3060, RAM, 16GB", None),
        (specs.vram_gb, "RAM 16GB", None),
        (specs.vram_type, "12GB gddr6x", "GDDR6X"),
        (specs.vram_type, "GDDR5 8GB", "GDDR5"),
        (specs.wattage, "12345 W", None),
        (specs.efficiency, "Nguồn 80 plus  Gold 750W", "80 plus Gold"),
        (specs.efficiency, "80Plus", "80Plus"),
        (specs.radiators, "Rad 360mm, 2400 mm, 120 mm", [120, 360]),
        (specs.weight_kg, "1,35 kg", 1.35),
        (specs.weight_kg, "Nặng 800 g", 0.8),
        (lambda c: specs.resolution(c)["height"], "2560 x 1440 (QHD)", 1440),
        (lambda c: specs.resolution(c)["label"], "1920×1080", "Full HD"),
        (lambda c: specs.measure(c, "HZ"), "144Hz 27 inch", "144"),
        (lambda c: specs.measure(c, "INCH", '"'), 'LG 27" IPS', "27"),
        (specs.split_list, None, None),
    ]
    text_rows = [(k, c) for k, (_, c, _) in enumerate(cases)]
    df = spark.createDataFrame(text_rows, "k int, c string")
    for k, (f, c, want) in enumerate(cases):
        assert df.where(F.col("k") == k).select(f(F.col("c"))).first()[0] == want, (k, c)


def test_aliases_of_models(spark):
    rows = [("Core i7 13700K", None), ("AMD Ryzen 7 5800X", "rx 6600"), ("i512400", "RTX Ti"), (None, "GTX1660 Ti")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, cpu string, gpu string")
    n, s, d = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("double")
    got = [r.x for r in df.select("k", text.alias_tokens(F.col("cpu"), F.col("gpu"), n, s, n, s, d, n).alias("x")).orderBy("k").collect()]
    assert got == [["i7-13700k", "i7 13700k", "i713700k"], ["ryzen 7 5800x", "r7 5800x", "rx 6600", "rx6600"], [], ["gtx 1660 ti", "gtx1660ti", "1660 ti"]]
