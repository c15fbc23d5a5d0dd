"""Sentences about feature values and the dictionary's descriptions, as relations of rules that names and values meet in order."""

from __future__ import annotations

from math import inf, nextafter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sentences as users know them.  $1 is the pattern's first group, {$1+$2} a sum of groups, {number} a number of the kind
# that NUMBERS names.  A rule holds for least <= value < below; the first one that fits is taken.
EVENTS = {"awal_ramadan": "awal Ramadan", "idulfitri": "Idulfitri", "iduladha": "Iduladha", "natal": "Natal", "tahun_baru": "Tahun Baru"}
SELLERS = {"prod": "produsen", "whole": "pedagang besar", "modern": "pasar modern"}


def _always(pattern: str, text: str) -> list[tuple]:
    return [(pattern, -inf, inf, text)]


def _parted(pattern: str, at: float, under: str, over: str) -> list[tuple]:
    return [(pattern, -inf, at, under), (pattern, at, inf, over)]


def _versus(pattern: str, what: str, under: str, over: str) -> list[tuple]:
    return _parted(pattern, 0.0, f"{what} {{size}}% {under}", f"{what} {{size}}% {over}")


SENTENCES: list[tuple[str, float, float, str]] = [
    *_always(r"^ret_(\d+)$", "Harga {pct}% dalam $1 hari terakhir"),
    *[r for t, s in SELLERS.items() for r in _always(rf"^ret_(\d+)_{t}$", f"Harga {s} {{pct}}% dalam $1 hari terakhir")],
    *_always("^ret_7_prev$", "Harga {pct}% dalam 7 hari terakhir"),
    *_parted("^dist_max_90$", nextafter(-0.005, 0), "Harga {size}% di bawah puncak 90 hari terakhir", "Harga sedang di puncak 90 hari terakhir"),
    *_always("^dist_min_90$", "Harga {rise}% di atas titik terendah 90 hari terakhir"),
    *_versus("^rel_365$", "Harga", "di bawah rata-rata setahun terakhir", "di atas rata-rata setahun terakhir"),
    *_versus("^ret_yoy$", "Harga", "lebih rendah dari tahun lalu", "lebih tinggi dari tahun lalu"),
    *_always("^seas_ret_14_ly$", "Tahun lalu pada periode ini harga {pct}% dalam 14 hari (pola musiman)"),
    *_always("^r14_now$", "Harga sudah berubah {points}% dalam 14 hari terakhir"),
    *_always("^gap_to_threshold$", "Tinggal {hundredths} poin persen lagi menuju ambang lonjakan"),
    *_always("^days_since_spike$", "{whole} hari sejak lonjakan terakhir"),
    *_always("^n_onsets_365$", "{whole} kali lonjakan dalam setahun terakhir"),
    *_always(r"^nat_ret_(\d+)$", "Harga nasional {pct}% ($1 hari)"),
    *_parted("^rel_nat$", 0.0, "Harga {size}% di bawah rata-rata nasional (berpotensi menyusul naik)", "Harga {size}% di atas rata-rata nasional"),
    *_always("^rel_nat_chg14$", "Selisih dengan harga nasional berubah {pct}% (14 hari)"),
    *_always("^nat_spike_share$", "{share}% provinsi lain sedang mengalami lonjakan komoditas ini"),
    *_always("^nat_spike_share_chg7$", "Porsi provinsi yang melonjak berubah {points} poin dalam 7 hari"),
    *[r for t, s in SELLERS.items() for r in _always(f"^nat_ret_14_{t}$", f"Harga {s} nasional {{pct}}% (14 hari)")],
    *_versus("^nat_margin_cons_prod$", "Secara nasional harga konsumen", "di bawah harga produsen", "di atas harga produsen"),
    *_always("^nat_margin_cons_prod_chg14$", "Margin konsumen-produsen nasional berubah {points} poin (14 hari)"),
    *_versus("^margin_cons_prod$", "Harga konsumen", "di bawah harga produsen", "di atas harga produsen"),
    *_always("^margin_cons_prod_chg14$", "Margin konsumen-produsen berubah {points} poin (14 hari)"),
    *_always("^margin_cons_prod_z90$", "Margin konsumen-produsen {sd} SD dari normalnya"),
    *_versus("^margin_cons_whole$", "Harga konsumen", "di bawah harga pedagang besar", "di atas harga pedagang besar"),
    *_always("^margin_cons_whole_chg14$", "Margin konsumen-pedagang besar berubah {points} poin (14 hari)"),
    *_versus("^margin_whole_prod$", "Harga pedagang besar", "di bawah harga produsen", "di atas harga produsen"),
    *_versus("^gap_modern$", "Harga pasar modern", "lebih murah dari pasar tradisional", "lebih mahal dari pasar tradisional"),
    *_always(r"^nbr_ret_(\d+)_mean$", "Harga di provinsi tetangga berubah rata-rata {pct}% dalam $1 hari"),
    *_always(r"^nbr_ret_(\d+)_max$", "Salah satu provinsi tetangga berubah {pct}% dalam $1 hari"),
    *_always("^nbr_spike_share$", "{share}% provinsi tetangga sedang mengalami lonjakan"),
    *_versus("^nbr_rel_price$", "Harga", "lebih murah dari provinsi tetangga (berpotensi menyusul naik)", "lebih mahal dari provinsi tetangga"),
    *_always(r"^lead_ret_(\d+)_mean$", 'Provinsi "pemimpin" (biasanya naik duluan) berubah rata-rata {pct}% dalam $1 hari'),
    *_always("^lead_spike_share$", '{share}% provinsi "pemimpin" sedang mengalami lonjakan'),
    *_parted("^is_ramadan$", 0.5, "Di luar bulan Ramadan", "Sedang bulan Ramadan"),
    *_parted("^is_nataru$", 0.5, "Di luar periode Nataru", "Periode Natal & Tahun Baru"),
    *_always("^doy_(sin|cos)$", "Pola musiman (waktu dalam setahun)"),
    *_always("^dow$", "Hari dalam seminggu"),
    *_always("^commodity_code$", "Karakter komoditas (riwayat volatilitas)"),
    *_always("^category_code$", "Karakter kelompok komoditas"),
    *_always("^province_code$", "Karakter provinsi (riwayat volatilitas)"),
    *_always(r"^vol_(\d+)$", "Harga sedang bergejolak: rata-rata ±{hundredths}% per hari ($1 hari terakhir)"),
    *_always(r"^z_(\d+)$", "Harga {sd} SD dari rata-rata $1 hari terakhir"),
    *[r for e, s in EVENTS.items() for r in _parted(f"^days_to_{e}$", 120.0, f"H-{{whole}} menuju {s}", f"Masih lebih dari 4 bulan menuju {s} (pola musiman)")],
    *[r for e, s in EVENTS.items() for r in _parted(f"^days_since_{e}$", 120.0, f"{{whole}} hari setelah {s}", f"Sudah lebih dari 4 bulan setelah {s} (pola musiman)")],
    *_always(r"^rain_(\d+)_anom$", "Curah hujan $1 hari {sd} SD dari normal"),
    *_always(r"^rain_(\d+)_anom_(?:centre|sentra)$", "Curah hujan $1 hari di sentra produksi {sd} SD dari normal"),
    *_always(r"^rain_(\d+)_anom_lag(\d+)$", "Curah hujan $1 hari ($2–{$1+$2} hari lalu) {sd} SD dari normal"),
    *_always(r"^rain_(\d+)_anom_lag(\d+)_(?:centre|sentra)$", "Curah hujan $1 hari di sentra produksi ($2–{$1+$2} hari lalu) {sd} SD dari normal"),
]
MISSING = ": data tidak tersedia"

# The dictionary's descriptions.
DESCRIPTIONS: list[tuple[str, str]] = [
    (r"^ret_(\d+)$", "Perubahan log harga konsumen $1 hari"),
    *[(rf"^ret_(\d+)_{t}$", f"Perubahan log harga {s} $1 hari") for t, s in SELLERS.items()],
    ("^ret_7_prev$", "Perubahan log harga konsumen minggu sebelumnya (t-14 → t-7)"),
    (r"^vol_(\d+)$", "Volatilitas: simpangan baku perubahan log harian $1 hari"),
    (r"^z_(\d+)$", "Z-score log harga terhadap $1 hari terakhir"),
    ("^dist_max_90$", "Jarak log harga ke harga tertinggi 90 hari terakhir"),
    ("^dist_min_90$", "Jarak log harga ke harga terendah 90 hari terakhir"),
    ("^rel_365$", "Log harga relatif terhadap rata-rata 365 hari"),
    ("^ret_yoy$", "Perubahan log harga dibanding 364 hari lalu"),
    ("^seas_ret_14_ly$", "Perubahan harga 14 hari yang terjadi tahun lalu pada jendela ke depan yang sama (pola musiman)"),
    ("^r14_now$", "Kenaikan harga 14 hari saat ini (P_t/P_t-14 - 1)"),
    ("^gap_to_threshold$", "Selisih ambang lonjakan dengan kenaikan 14 hari saat ini"),
    ("^days_since_spike$", "Hari sejak terakhir berstatus lonjak (maks 365)"),
    ("^n_onsets_365$", "Jumlah kejadian lonjakan dalam 365 hari terakhir"),
    (r"^nat_ret_(\d+)$", "Perubahan log harga nasional $1 hari"),
    *[(rf"^nat_ret_(\d+)_{t}$", f"Perubahan log harga nasional $1 hari ({s})") for t, s in SELLERS.items()],
    ("^rel_nat$", "Log harga provinsi relatif terhadap harga nasional"),
    ("^rel_nat_chg14$", "Perubahan 14 hari dari selisih harga provinsi vs nasional"),
    ("^nat_spike_share$", "Porsi provinsi yang sedang lonjak (komoditas sama)"),
    ("^nat_spike_share_chg7$", "Perubahan 7 hari porsi provinsi yang sedang lonjak"),
    ("^nat_margin_cons_prod$", "Margin log harga konsumen - produsen tingkat nasional"),
    ("^nat_margin_cons_prod_chg14$", "Perubahan 14 hari margin konsumen-produsen nasional"),
    ("^margin_cons_prod$", "Margin log harga konsumen - produsen (provinsi)"),
    ("^margin_cons_prod_chg14$", "Perubahan 14 hari margin konsumen-produsen"),
    ("^margin_cons_prod_z90$", "Z-score margin konsumen-produsen terhadap 90 hari terakhir"),
    ("^margin_cons_whole$", "Margin log harga konsumen - pedagang besar"),
    ("^margin_cons_whole_chg14$", "Perubahan 14 hari margin konsumen-pedagang besar"),
    ("^margin_whole_prod$", "Margin log harga pedagang besar - produsen"),
    ("^gap_modern$", "Log harga pasar modern - pasar tradisional"),
    (r"^nbr_ret_(\d+)_mean$", "Rata-rata perubahan $1 hari di 3 provinsi terdekat"),
    (r"^nbr_ret_(\d+)_max$", "Perubahan $1 hari tertinggi di 3 provinsi terdekat"),
    ("^nbr_spike_share$", "Porsi provinsi tetangga yang sedang lonjak"),
    ("^nbr_rel_price$", "Log harga relatif terhadap rata-rata tetangga"),
    ("^lead_ret_7_mean$", "Rata-rata perubahan 7 hari di provinsi pemimpin (jaringan Granger)"),
    (r"^lead_ret_(\d+)_mean$", "Rata-rata perubahan $1 hari di provinsi pemimpin"),
    ("^lead_spike_share$", "Porsi provinsi pemimpin yang sedang lonjak"),
    ("^is_ramadan$", "1 jika bulan Ramadan"),
    ("^is_nataru$", "1 jika 15 Des - 7 Jan"),
    ("^doy_sin$", "Musiman tahunan (sin hari ke-n)"),
    ("^doy_cos$", "Musiman tahunan (cos hari ke-n)"),
    ("^dow$", "Hari dalam minggu (0=Senin)"),
    ("^commodity_code$", "Kode varian komoditas (kategori LightGBM)"),
    ("^category_code$", "Kode kategori komoditas (kategori LightGBM)"),
    ("^province_code$", "Kode provinsi (kategori LightGBM)"),
    *[(f"^days_to_{e}$", f"Hari menuju {e.replace('_', ' ')} berikutnya (maks 120)") for e in EVENTS],
    *[(f"^days_since_{e}$", f"Hari sejak {e.replace('_', ' ')} terakhir (maks 120)") for e in EVENTS],
    (r"^rain_(\d+)_anom$", "Anomali (z) curah hujan $1 hari — provinsi sendiri"),
    (r"^rain_(\d+)_anom_(?:centre|sentra)$", "Anomali (z) curah hujan $1 hari — rata-rata sentra produksi"),
    (r"^rain_(\d+)_anom_lag(\d+)$", "Anomali (z) curah hujan $1 hari, digeser $2 hari — provinsi sendiri"),
    (r"^rain_(\d+)_anom_lag(\d+)_(?:centre|sentra)$", "Anomali (z) curah hujan $1 hari, digeser $2 hari — rata-rata sentra produksi"),
]

#: Kinds of numbers in a sentence: of which expression of the value, with how many decimals, and whether a plus is shown.
NUMBERS: dict[str, tuple[str, int, bool]] = {
    "pct": ("expm1(value) * 100", 1, True),
    "size": ("abs(expm1(value)) * 100", 1, False),
    "rise": ("expm1(value) * 100", 1, False),
    "points": ("value * 100", 1, True),
    "hundredths": ("value * 100", 1, False),
    "share": ("value * 100", 0, False),
    "whole": ("value", 0, False),
    "sd": ("value", 1, True),
}


def sentences_for(names: DataFrame) -> DataFrame:
    """(feature, rank, least, below, text): the rules of each name in ``names`` (feature), groups filled in.

    Names are those of columns, so they and the rules are few whatever the facts' size.
    """
    kinds = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("pattern", T.StringType()), T.StructField("least", T.DoubleType()), T.StructField("below", T.DoubleType()), T.StructField("text", T.StringType())])
    rules = names.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(SENTENCES)], kinds)
    met = names.select("feature").distinct().join(F.broadcast(rules), F.expr("rlike(feature, pattern)"))
    filled = met.select("feature", "rank", "least", "below", F.expr("regexp_replace(feature, pattern, text)").alias("text"))
    first, second = (F.regexp_extract("text", r"\{(\d+)\+(\d+)\}", i).try_cast("int") for i in (1, 2))
    summed = F.regexp_replace("text", F.lit(r"\{\d+\+\d+\}"), F.coalesce((first + second).cast("string"), F.lit("")))
    return filled.withColumn("text", summed)


def number(kind: str, decimal: str = ",") -> Column:
    """The column value as text in one of NUMBERS; exact halves go to the even digit, the sign of a rounded zero stays."""
    of, digits, signed = NUMBERS[kind]
    rounded = F.rint(F.expr(of) * 10**digits) / 10**digits
    return F.replace(F.format_string(f"%{'+' if signed else ''}.{digits}f", rounded), F.lit("."), F.lit(decimal))


def _short(x: Column) -> Column:
    """Three significant digits, trailing zeros dropped, with an exponent below 1e-4 and from 1000 on."""
    full = F.format_string("%.2e", x)
    plain = F.regexp_replace(full.cast("decimal(12,6)").cast("string"), r"\.?0+$", "")
    exponent = F.substring_index(full, "e", -1).cast("int")
    return F.when(x == 0, "0").when(exponent.between(-4, 2), plain).otherwise(F.regexp_replace(full, r"\.?0+e", "e"))


def describe(facts: DataFrame, names: DataFrame, decimal: str = ",") -> DataFrame:
    """``facts`` (feature, value, and more) with ``text``, a sentence about the value; every row stays, once.

    ``names`` (feature) are the features there are.  A null or non-finite value is said to be missing; a feature that no rule fits reads "name = value".
    The rules of a name travel as one broadcast array, and the first whose range holds the value is taken, so facts aren't shuffled.
    """
    listed = sentences_for(names).groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("rank", "least", "below", "text"))).alias("_rules"))  # a row for each column name
    x = facts.join(F.broadcast(listed), "feature", "left").withColumn("_was", F.col("value")).withColumn("value", F.col("value").cast("double"))
    fits = F.filter("_rules", lambda r: (F.col("value") >= r["least"]) & (F.col("value") < r["below"]))
    x = x.withColumn("_said", F.get(fits, F.lit(0))["text"])
    text = F.col("_said")
    for kind in NUMBERS:
        text = F.when(F.contains("_said", F.lit(f"{{{kind}}}")), F.replace("_said", F.lit(f"{{{kind}}}"), number(kind, decimal))).otherwise(text)
    known = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < inf)
    text = F.when(~known, F.concat("feature", F.lit(MISSING))).when(F.col("_said").isNull(), F.concat_ws(" = ", "feature", _short(F.col("value")))).otherwise(text)
    return x.withColumn("text", text).withColumn("value", F.col("_was")).select(*[f"`{c}`" for c in facts.columns], "text")


def descriptions(names: DataFrame) -> DataFrame:
    """(feature, description) for each name in ``names`` (feature); one that no rule fits is its own description."""
    rules = names.sparkSession.createDataFrame([(i, p, t) for i, (p, t) in enumerate(DESCRIPTIONS)], "rank int, pattern string, text string")
    met = names.select("feature").distinct().join(F.broadcast(rules), F.expr("rlike(feature, pattern)"), "left")
    said = F.min_by(F.expr("regexp_replace(feature, pattern, text)"), "rank")
    return met.groupBy("feature").agg(F.coalesce(said, "feature").alias("description"))


def names_of(spark: SparkSession, features: list[str]) -> DataFrame:
    return spark.createDataFrame([(f,) for f in features], "feature string")
