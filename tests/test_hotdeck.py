from pyspark.sql import functions as F

from tessera.operators import hotdeck
from tests.conftest import rows


def brute(data):
    out = []
    for rid, g, at, v in data:
        if v is not None or g is None:
            continue
        own = sorted((x for x in data if x[1] == g), key=lambda x: (x[2], x[0]))
        k = own.index((rid, g, at, v))
        prev = next((x for x in reversed(own[:k]) if x[3] is not None), None)
        after = next((x for x in own[k + 1 :] if x[3] is not None), None)
        if prev and (not after or at - prev[2] <= after[2] - at):
            out.append((rid, prev[3], prev[0], at - prev[2], "previous"))
        elif after:
            out.append((rid, after[3], after[0], after[2] - at, "next"))
    return sorted(out, key=str)


def test_chunks_do_not_change_the_nearest_donor(spark):
    import random

    r = random.Random(3)
    data = [(i, r.choice(["hot"] * 6 + ["b", "c", None]), float(r.randrange(60)), r.choice([None, None, None, "x", "y"])) for i in range(400)]
    df = spark.createDataFrame(data, "id long, g string, at double, v string")
    for width in (1, 7, 1000):
        got = hotdeck.nearest_donors(df, row_id=F.col("id"), group=[F.col("g")], chunk=F.floor(F.col("at") / width), order=F.col("at"), value=F.col("v"))
        assert rows(got) == brute(data)


CHECKLISTS = "row_id long, loc_id1 string, obs_year int, obs_month int, obs_day int, obs_time double, county string, group_id string, primary_checklist_flag string, effort_distance_km string, count_type string, value string"
COUNTIES = "county string, row_id long"


def fills(spark, data, counties=(("Elm", 1), (None, 2))):
    clean = hotdeck.clean_checklists(spark.createDataFrame(data, CHECKLISTS), spark.createDataFrame(list(counties), COUNTIES))
    return clean, hotdeck.fill_missing(clean, hotdeck.checklist_fills())


def test_rules_of_each_field(spark):
    data = [
        (1, "l1", 2010, 5, 1, 6.0, " ELM ", "G1", "1.0", "-2.5", "P22", "z"),
        (2, " L1 ", 2010, 5, 1, 6.0, "?", None, "9", "NaN", "P22 ", None),
        (3, "L1", 2010, 5, 30, None, None, "G000", "?", "999.9", "P34", None),
        (4, "?", 2010, 5, 1, 6.0, None, "G1 ", "null", "km", "P22", None),
        (5, None, None, None, None, None, None, None, None, None, None, None),
        (6, "L1", 2010, 5, 1, 6.0, "oak", "g1", "1d", "1e400", "P21", None),
        (7, "L2", 2010, 5, 1, 6.0, "elm", "G7", "0", "3", "P20", None),
    ]
    clean, found = fills(spark, data)
    # Row 2 has no group of its own, so a filled group_id does not lend it a flag.
    assert rows(found.select("row_id", "field_name", "value", "donor_id")) == [
        (2, "county", "ELM", 1), (2, "effort_distance_km", "2.5", 1), (2, "group_id", "G1", 1), (3, "county", "ELM", 1), (3, "effort_distance_km", "2.5", 1), (4, "effort_distance_km", "2.5", 1),
        (4, "primary_checklist_flag", "1", 1), (6, "county", "ELM", 1), (6, "group_id", "G1", 1),
    ]
    wide = {r["row_id"]: r for r in hotdeck.filled_checklists(clean, found).collect()}
    assert len(wide) == 7 and wide[3]["county"] == "ELM" and wide[3]["county_is_filled"] and wide[3]["county_donor_days"] == 28.75
    assert wide[1]["effort_distance_km"] == 2.5 and not wide[1]["effort_distance_km_is_filled"] and wide[5]["county"] is None


def test_empty_and_repeated(spark):
    clean, found = fills(spark, [])
    assert found.count() == 0 and hotdeck.filled_checklists(clean, found).count() == 0
    _, found = fills(spark, [(1, "L1", 2010, 5, 1, 6.0, None, None, None, None, "P22", None)] * 2, counties=())
    assert found.count() == 0
