import math

import pytest

from tidepanel.functions import texts


@pytest.mark.parametrize(("feature", "value", "want"), [
    ("ret_7", 0.0926, "Harga +9,7% dalam 7 hari terakhir"),
    ("ret_14_whole", -0.05, "Harga pedagang besar -4,9% dalam 14 hari terakhir"),
    ("ret_7_prev", 0.01, "Harga +1,0% dalam 7 hari terakhir"),
    ("dist_max_90", -0.005, "Harga 0,5% di bawah puncak 90 hari terakhir"),
    ("dist_max_90", -0.0049, "Harga sedang di puncak 90 hari terakhir"),
    ("rel_365", -0.1, "Harga 9,5% di bawah rata-rata setahun terakhir"),
    ("rel_365", 0.0, "Harga 0,0% di atas rata-rata setahun terakhir"),
    ("gap_to_threshold", 0.0025, "Tinggal 0,2 poin persen lagi menuju ambang lonjakan"),
    ("nat_spike_share", 0.125, "12% provinsi lain sedang mengalami lonjakan komoditas ini"),
    ("nat_spike_share_chg7", -0.0004, "Porsi provinsi yang melonjak berubah -0,0 poin dalam 7 hari"),
    ("days_to_idulfitri", 12.0, "H-12 menuju Idulfitri"),
    ("days_since_natal", 120.0, "Sudah lebih dari 4 bulan setelah Natal (pola musiman)"),
    ("days_since_spike", 3.0, "3 hari sejak lonjakan terakhir"),
    ("rain_30_anom_lag60_centre", 1.25, "Curah hujan 30 hari di sentra produksi (60–90 hari lalu) +1,2 SD dari normal"),
    ("vol_14", 0.0312, "Harga sedang bergejolak: rata-rata ±3,1% per hari (14 hari terakhir)"),
    ("is_nataru", 1.0, "Periode Natal & Tahun Baru"),
    ("z_30", None, "z_30: data tidak tersedia"),
    ("z_30", math.inf, "z_30: data tidak tersedia"),
    ("something", 1234.5, "something = 1.23e+03"),
    ("something", 0.5, "something = 0.5"),
    ("something", -120.0, "something = -120"),
    ("something", 0.00001, "something = 1e-05"),
    ("something", math.nan, "something: data tidak tersedia"),
])
def test_sentence_about_a_value(spark, feature, value, want):
    facts = spark.createDataFrame([(feature, value)], "feature string, value double")
    assert texts.describe(facts, facts).first().text == want


def test_every_row_stays_once_with_its_own_value(spark):
    facts = spark.createDataFrame([("dow", 1, 7), ("dow", 1, 7), ("is_ramadan", None, 8)], "feature string, value int, `a.b` int")
    got = texts.describe(facts, facts)
    assert got.columns == ["feature", "value", "a.b", "text"] and got.schema["value"].dataType.simpleString() == "int"
    assert sorted(map(str, got.collect())) == sorted(["Row(feature='dow', value=1, a.b=7, text='Hari dalam seminggu')"] * 2 + ["Row(feature='is_ramadan', value=None, a.b=8, text='is_ramadan: data tidak tersedia')"])


def test_descriptions_take_the_first_rule(spark):
    names = texts.names_of(spark, ["lead_ret_7_mean", "lead_ret_14_mean", "rain_30_anom_lag60_sentra", "unheard"])
    assert {r.feature: r.description for r in texts.descriptions(names).collect()} == {
        "lead_ret_7_mean": "Rata-rata perubahan 7 hari di provinsi pemimpin (jaringan Granger)", "lead_ret_14_mean": "Rata-rata perubahan 14 hari di provinsi pemimpin",
        "rain_30_anom_lag60_sentra": "Anomali (z) curah hujan 30 hari, digeser 60 hari — rata-rata sentra produksi", "unheard": "unheard"}


def test_facts_are_not_shuffled(spark):
    facts = spark.range(100).selectExpr("'ret_7' as feature", "id / 100 as value")
    plan = texts.describe(facts, texts.names_of(spark, ["ret_7"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") >= 1 and "rightHint=(strategy=broadcast)" in plan
