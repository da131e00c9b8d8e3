"""Readers, writers, and whole jobs over files."""

import datetime as dt
import gzip
import json

import pytest

from tests.conftest import hours, rows_of
from tidemark.functions import fixed_values as fixed
from tidemark.operators.clean import slice_event_type
from tidemark.plans import event_table, extracts, training
from tidemark.plans.phenotype import load_urine_rate
from tidemark.sources import readers, writers

RAW = {
    "hosp/patients.csv.gz": "subject_id,gender,anchor_age,anchor_year,anchor_year_group,dod\n1,F,50,2150,2008 - 2010,\n2,M,60,2151,2008 - 2010,2151-02-03\n",
    "hosp/admissions.csv.gz": (
        "subject_id,hadm_id,admittime,dischtime,admission_type,admission_location,discharge_location,insurance,language,marital_status,race,hospital_expire_flag\n"
        "1,10,2150-01-01 00:00:00,2150-01-09 12:00:00,URGENT,ER,HOME,Medicare,EN,,WHITE,0\n"
        "2,20,2151-01-01 00:00:00,2151-02-03 12:00:00,ELECTIVE,ER,,Other,EN,,ASIAN,1\n"),
    "icu/icustays.csv.gz": "subject_id,hadm_id,stay_id,first_careunit,last_careunit,intime,outtime\n1,10,100,MICU,MICU,2150-01-01 01:00:00,2150-01-04 01:00:00\n",
    "hosp/diagnoses_icd.csv.gz": "subject_id,hadm_id,seq_num,icd_code,icd_version\n1,10,1,N179,10\n2,20,1,4019,9\n2,99,1,4019,9\n",
    "hosp/procedures_icd.csv.gz": "subject_id,hadm_id,seq_num,chartdate,icd_code,icd_version\n1,10,1,2150-01-02,0T773DZ,10\n",
    "hosp/prescriptions.csv.gz": (
        "subject_id,hadm_id,starttime,stoptime,drug,ndc,prod_strength,dose_val_rx,dose_unit_rx,route\n"
        '1,10,2150-01-01 02:00:00,2150-01-02 02:00:00,"Heparin, flush",0,5mL,"1,000",UNIT,IV\n'
        "1,10,2150-01-01 03:00:00,,Drug,0,5mL,1-3,mg,PO\n"),
    "hosp/d_labitems.csv.gz": "itemid,label,fluid,category\n50912,Creatinine,Blood,Chemistry\n",
    "hosp/labevents.csv.gz": (
        "subject_id,hadm_id,itemid,charttime,storetime,value,valuenum,valueuom,flag\n"
        "1,10,50912,2150-01-01 03:00:00,2150-01-01 04:00:00,1.0,1.0,mg/dL,\n"
        "1,10,50912,2150-01-04 03:00:00,2150-01-04 04:00:00,1.4,1.4,mg/dL,abnormal\n"
        "1,10,50912,2150-01-05 03:00:00,2150-01-05 04:00:00,1.8,1.8,mg/dL,abnormal\n"
        "1,,99999,2150-01-05 03:00:00,2150-01-05 04:00:00,___,,mg/dL,\n"),
    "hosp/hcpcsevents.csv.gz": "subject_id,hadm_id,chartdate,hcpcs_cd,seq_num,short_description\n1,10,2150-01-02,99218,1,Observation\n",
}
DICTIONARIES = {
    "diagnoses_icd": "icd_code,icd_version,long_title\nN179,10,Kidney failure\n4019,9,Hypertension\n",
    "procedures_icd": "icd_code,icd_version,long_title\n",
    "labevents": "itemid,label,fluid,category\n50912,Creatinine,Blood,Chemistry\n",
}


@pytest.fixture
def raw(tmp_path):
    for name, text in RAW.items():
        path = tmp_path / "raw" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(gzip.compress(text.encode()))
    named = {}
    for event_type, text in DICTIONARIES.items():
        path = tmp_path / f"d_{event_type}.csv"
        path.write_text(text)
        named[event_type] = str(path)
    return str(tmp_path / "raw"), named


def test_raw_events(spark, raw):
    events = readers.read_raw_events(spark, raw[0])
    counts = {r["event_type"]: r["count"] for r in events.groupBy("event_type").count().collect()}
    assert counts == {"patients": 2, "admissions": 2, "icustays": 1, "diagnoses_icd": 2, "procedures_icd": 1,
                      "prescriptions": 2, "labevents": 3, "hcpcsevents": 1}
    assert rows_of(slice_event_type(events, "diagnoses_icd"), "patient_id", "timestamp") == [
        ("1", dt.datetime(2150, 1, 9, 12)), ("2", dt.datetime(2151, 2, 3, 12))]


def test_event_table(spark, raw):
    events = event_table.build_event_table(spark, *raw)
    types = dict(events.dtypes)
    assert types["hadm_id"] == "string" and types["labevents/valuenum"] == "float"
    assert types["admissions/hospital_expire_flag"] == "boolean" and types["patients/dod"] == "date"
    assert not [c for c in events.columns if c.endswith("/hadm_id")]
    assert rows_of(events.filter("event_type = 'prescriptions'"), "prescriptions/dose_val_rx") == [(2.0,), (1000.0,)]
    assert rows_of(events.filter("event_type = 'diagnoses_icd'"), "hadm_id", "diagnoses_icd/description") == [
        ("10", "Kidney failure"), ("20", "Hypertension")]
    assert rows_of(events.filter("event_type = 'hcpcsevents'"), "timestamp") == [(dt.datetime(2150, 1, 2),)]
    labs = events.filter("event_type = 'labevents'")
    assert rows_of(labs.select("`labevents/description`").distinct()) == [("Creatinine",)]


def test_declarations():
    types = readers.declared_types()
    assert types["labevents/valuenum"] == "Float" and "labevents/label" not in types and "admissions/hadm_id" not in types
    assert readers.declared_measures()["labevents/valuenum"] == fixed.Measure(("labevents/label",), "labevents/valueuom")


def test_stored_tables_are_rebuilt_only_on_change(spark, raw, tmp_path):
    path = str(tmp_path / "events")
    stored = event_table.ensure_event_table(spark, *raw, path)
    assert stored.count() == 14
    state = writers.stored_state(spark, path)
    first = writers.source_state(spark, [path])
    event_table.ensure_event_table(spark, *raw, path)
    assert writers.source_state(spark, [path]) == first

    extracts = {}
    for name, column, rows in (("weights", "valuenum", [(226512, 70.0)]), ("urine", "value", [(226559, 50.0)])):
        df = spark.createDataFrame(
            [(1, 10, 100, item, dt.datetime(2150, 1, 1, h), v, "u") for h in range(2) for item, v in rows],
            f"subject_id bigint, hadm_id bigint, stay_id bigint, itemid bigint, charttime timestamp_ntz, {column} double, valueuom string")
        extracts[name] = str(tmp_path / name)
        df.write.parquet(extracts[name])
    diagnoses = str(tmp_path / "diagnoses")
    found = event_table.ensure_diagnoses(spark, path, extracts["weights"], extracts["urine"], diagnoses)
    assert rows_of(found, "hadm_id", "timestamp") == [("10", dt.datetime(2150, 1, 5, 3))]
    assert writers.stored_state(spark, diagnoses)["upstream"] == state
    assert event_table.load_enriched(spark, path, diagnoses).count() == 15

    with open(raw[1]["diagnoses_icd"], "a") as dictionary:
        dictionary.write("I10,10,Other\n")
    event_table.ensure_event_table(spark, *raw, path)
    assert writers.stored_state(spark, path) != state
    assert writers.source_state(spark, [path]) != first


def test_an_unfinished_build_is_not_taken_for_finished(spark, tmp_path):
    path = str(tmp_path / "set")
    state = writers.fingerprint(spark, version=1)
    writers.ensure_dataset(spark, path, state, lambda: spark.range(3))

    def fail():
        raise RuntimeError("broke off")

    with pytest.raises(RuntimeError):
        writers.ensure_dataset(spark, path, writers.fingerprint(spark, version=2), fail)
    assert writers.stored_state(spark, path) is None
    assert writers.ensure_dataset(spark, path, state, lambda: spark.range(5)).count() == 5


def test_parquet_reader_refuses_missing_and_empty(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    for name in ("empty", "missing"):
        with pytest.raises(FileNotFoundError):
            readers.read_parquet(spark, str(tmp_path / name))


def test_vocabulary_export_keeps_stray_quotes(spark, tmp_path):
    path = tmp_path / "CONCEPT.csv"
    path.write_text('concept_id\tconcept_name\n1\t5" tube\n2\t"open\n3\tplain\n')
    got = readers.read_vocabulary_export(spark, str(path))
    assert got.dtypes == [("concept_id", "string"), ("concept_name", "string")]
    assert rows_of(got) == [("1", '5" tube'), ("2", '"open'), ("3", "plain")]


def test_item_extracts(spark, tmp_path):
    path = tmp_path / "chartevents.csv.gz"
    path.write_bytes(gzip.compress(
        b"subject_id,hadm_id,stay_id,caregiver_id,charttime,storetime,itemid,value,valuenum,valueuom,warning\n"
        b"1,10,100,7,2150-01-01 01:00:00,,226512,70,70,kg,0\n1,10,100,7,2150-01-01 01:00:00,,1,70,70,kg,0\n"
        b"1,10,100,7,2150-01-01 02:00:00,,226531,150,150,,0\n"))
    got = readers.read_weights(spark, str(path), partitions=2)
    assert got.columns == list(fixed.WEIGHT_COLUMNS)
    assert rows_of(got, "itemid", "valuenum", "charttime") == [
        (226512, 70.0, dt.datetime(2150, 1, 1, 1)), (226531, 150.0, dt.datetime(2150, 1, 1, 2))]
    assert rows_of(readers.read_urine(spark, str(path))) == []


def test_extracts_are_made_once(spark, tmp_path):
    header = "subject_id,hadm_id,stay_id,caregiver_id,charttime,storetime,itemid,value,valuenum,valueuom,warning\n"
    row = "1,10,100,7,2150-01-01 0{}:00:00,,{},5,{},kg,0\n"
    chart, output = tmp_path / "chartevents.csv.gz", tmp_path / "outputevents.csv.gz"
    chart.write_bytes(gzip.compress((header + row.format(1, 226512, 70) + row.format(2, 1, 9)).encode()))
    output.write_bytes(gzip.compress((header + row.format(3, 226559, 1)).encode()))
    paths = (str(chart), str(output), str(tmp_path / "extracts"))
    made = extracts.ensure_extracts(spark, *paths, partitions=2)
    assert rows_of(made.weights, "itemid", "valuenum") == [(226512, 70.0)] and rows_of(made.urine, "itemid", "value") == [(226559, 5.0)]
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "extracts").rglob("*.parquet") if p.is_file()}
    extracts.ensure_extracts(spark, *paths, partitions=2)
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "extracts").rglob("*.parquet") if p.is_file()}
    chart.write_bytes(gzip.compress((header + row.format(1, 226512, 70) + row.format(2, 226531, 150)).encode()))
    again = extracts.ensure_extracts(spark, *paths, partitions=2)
    assert again.weights.count() == 2 and again.urine.count() == 1
    left = {p for p in (tmp_path / "extracts").rglob("*.parquet") if p.is_file() and p in files}
    assert left and all("urine" in str(p) for p in left)
    rate = load_urine_rate(again.weights, again.urine)
    assert rate.count() == 1


def test_nothing_is_overwritten(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.write_new(spark.range(3), path)
    with pytest.raises(FileExistsError):
        writers.write_new(spark.range(4), path)
    assert spark.read.parquet(path).count() == 3


def test_events_are_written_in_order_with_births_first(spark, frame, tmp_path):
    rows = [(s, hours(h), c) for s in (2, 1) for h in (3, 1) for c in ("A", "MEDS_BIRTH", "Z")]
    path = str(tmp_path / "data")
    writers.write_events(frame("subject_id bigint, time timestamp_ntz, code string", rows), path)
    for part in (tmp_path / "data").glob("*.parquet"):
        found = [(r[0], r[1], r[2] != "MEDS_BIRTH") for r in spark.read.parquet(str(part)).collect()]
        assert found == sorted(found)
    assert spark.read.parquet(path).count() == 12


ENTRIES = "index bigint, code string, text string, type int, val_start double, val_end double, weight double"


@pytest.fixture
def coded(spark, tmp_path):
    """A small coded dataset with its vocabulary files; returns the path of each."""
    rows = []
    for s in range(1, 11):
        rows.append((s, hours(-1000), "MEDS_BIRTH", None, None, None, None, 0))
        rows.append((s, hours(0), "MIMIC_IV_Admission/URGENT", None, None, hours(100), s * 10, 1))
        rows += [(s, hours(h), "LAB/x" if h % 2 else "LAB/none", 1.0 * h, None, None, s * 10, h + 2) for h in range(60)]
    events = spark.createDataFrame(
        rows, "subject_id bigint, time timestamp_ntz, code string, numeric_value float, text_value string, "
              "end timestamp_ntz, visit_id bigint, ordinal bigint")
    frames = {
        "events": events,
        "entries": spark.createDataFrame([(0, "L/1", None, 0, None, None, -0.5), (1, "Visit/IP", None, 0, None, None, -0.1)], ENTRIES),
        "closure": spark.createDataFrame([("L/2", "L/2"), ("L/2", "L/1"), ("L/1", "L/1")], "code string, ancestor string"),
        "metadata": spark.createDataFrame([("LAB/x", ["L/2"])], "code string, parent_codes array<string>"),
        "diagnoses": spark.createDataFrame([(s, s * 10, hours(70)) for s in (1, 2)], "subject_id bigint, visit_id bigint, timestamp timestamp_ntz"),
    }
    paths = {name: str(tmp_path / name) for name in frames}
    for name, df in frames.items():
        df.write.parquet(paths[name])
    paths["concept"], paths["relationship"] = str(tmp_path / "CONCEPT.csv"), str(tmp_path / "RELATIONSHIP.csv")
    (tmp_path / "CONCEPT.csv").write_text("concept_id\tconcept_name\tvocabulary_id\tconcept_code\n1\tOne\tL\t1\n")
    (tmp_path / "RELATIONSHIP.csv").write_text("concept_id_1\tconcept_id_2\trelationship_id\tinvalid_reason\n")
    return paths


ABOUT = {"dataset_name": "made up", "dataset_version": "1"}


def test_jobs_from_codes_to_sequences(spark, coded, tmp_path):
    out = {n: str(tmp_path / f"out_{n}") for n in ("map", "rewritten", "survived", "labels", "split", "sequences")}
    covered = training.run_concept_map(
        spark, coded["events"], out["map"], entries=coded["entries"], vocab_size=2, closure=coded["closure"],
        metadata=coded["metadata"], concept=coded["concept"], relationship=coded["relationship"])
    assert (covered["mapped_events"], covered["events"]) == (310, 620)
    assert rows_of(spark.read.parquet(out["map"]), "code", "vocab_code", "hops") == [
        ("LAB/x", "L/1", 1), ("MIMIC_IV_Admission/URGENT", "Visit/IP", 0)]

    training.run_rewrite(spark, coded["events"], out["rewritten"], concept_map=out["map"], concept=coded["concept"], description=ABOUT)
    data = f"{out['rewritten']}/data"
    assert rows_of(spark.read.parquet(data).groupBy("code").count()) == [("L/1", 300), ("MEDS_BIRTH", 10), ("Visit/IP", 10)]
    assert rows_of(spark.read.parquet(f"{out['rewritten']}/metadata/codes.parquet"), "code", "description")[0] == ("L/1", "One")
    assert json.loads((tmp_path / "out_rewritten/metadata/dataset.json").read_text()) == ABOUT

    counts = training.run_surviving(spark, coded["diagnoses"], data, out["survived"])
    assert (counts["n_admissions"], counts["n_stranded"]) == (2, 0)
    summary = training.run_labels(spark, data, out["survived"], out["labels"])
    assert (summary["n_landmarks"], summary["n_positive"], summary["n_admissions"]) == (8 * 5 + 2 * 2, 4, 10)

    training.run_split(spark, data, data, out["survived"], out["split"])
    assert rows_of(spark.read.parquet(out["split"]).groupBy("stratum").count()) == [("negative_1", 8), ("positive_1", 2)]

    written = training.run_sequences(
        spark, data, out["labels"], out["sequences"], entries=coded["entries"], vocab_size=2, length=16, stride=8,
        age_mean=0.0, age_std=1.0, ordinal="ordinal")
    # 31 tokens per subject make three chunks of 16, 16 and 15 positions.
    assert written == (10 * 47, 44, 30)
    placed = spark.read.parquet(f"{out['sequences']}/labels")
    assert placed.join(spark.read.parquet(f"{out['sequences']}/sequences"), ["sequence_id", "position"]).count() == 44

    batches = training.run_batches(
        spark, out["sequences"], str(tmp_path / "batches"), entries=coded["entries"], vocab_size=2, closure=coded["closure"], batch_size=8)
    assert batches == (30, 470, 44)
    grids = spark.read.parquet(str(tmp_path / "batches/sequences"))
    assert rows_of(grids.groupBy("batch").count()) == [(0, 8), (1, 8), (2, 8), (3, 6)]
    assert {(r.seq_len, len(r.ages)) for r in grids.collect()} == {(16, 16)}
    with pytest.raises(FileExistsError):
        training.run_batches(
            spark, out["sequences"], str(tmp_path / "batches"), entries=coded["entries"], vocab_size=2, closure=coded["closure"], batch_size=8)

    # Without the column, events are numbered by what they hold; the timelines have the same shape, twice alike.
    bare = str(tmp_path / "bare")
    spark.read.parquet(data).drop("ordinal").write.parquet(bare)
    made = []
    for n in (1, 2):
        dest = str(tmp_path / f"numbered{n}")
        ages = str(tmp_path / f"ages{n}")
        spark.createDataFrame([(0.0, 1.0)], "age_mean double, age_std double").write.parquet(ages)
        options = dict(entries=coded["entries"], vocab_size=2, length=16, stride=8, ages=ages)
        assert training.run_sequences(spark, bare, out["labels"], dest, **options) == written
        made.append(rows_of(spark.read.parquet(f"{dest}/sequences"), "sequence_id", "position", "index", "time"))
    assert made[0] == made[1]

    for again in (
        lambda: training.run_labels(spark, data, out["survived"], out["labels"]),
        lambda: training.run_split(spark, data, data, out["survived"], out["split"]),
        lambda: training.run_surviving(spark, coded["diagnoses"], data, out["survived"]),
        lambda: training.run_rewrite(spark, coded["events"], out["rewritten"], concept_map=out["map"], concept=coded["concept"], description=ABOUT),
    ):
        with pytest.raises(FileExistsError):
            again()


@pytest.mark.parametrize("rows", [[], [(1.0, 0.0)], [(1.0, None)], [(1.0, 2.0), (1.0, 2.0)]])
def test_bad_age_statistics_are_refused(spark, tmp_path, rows):
    path = str(tmp_path / "ages")
    spark.createDataFrame(rows, "age_mean double, age_std double").write.parquet(path)
    with pytest.raises(ValueError):
        readers.read_age_statistics(spark, path)


def test_labels_refuse_stranded_admissions_and_missing_inputs(spark, coded, tmp_path):
    stranded = str(tmp_path / "stranded")
    training.run_surviving(spark, coded["diagnoses"], coded["closure"].replace("closure", "events"), stranded)
    bad = str(tmp_path / "bad")
    spark.read.parquet(stranded).selectExpr("subject_id", "visit_id", "timestamp", "0.0D AS n_surviving_events").write.parquet(bad)
    with pytest.raises(ValueError):
        training.run_labels(spark, coded["events"], bad, str(tmp_path / "labels"))
    with pytest.raises(FileNotFoundError):
        training.run_labels(spark, str(tmp_path / "no"), stranded, str(tmp_path / "labels"))
    with pytest.raises(FileNotFoundError):
        training.run_rewrite(spark, coded["events"], str(tmp_path / "r"), concept_map=coded["closure"], concept=str(tmp_path / "no"), description=ABOUT)
    assert not (tmp_path / "labels").exists() and not (tmp_path / "r").exists()


@pytest.mark.parametrize("row", ["3,4,5", "6"])
def test_ragged_rows_are_refused(spark, tmp_path, row):
    (tmp_path / "t.csv").write_text(f"a,b\n1,2\n{row}\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILED_READ_FILE"):
        readers.read_text_table(spark, str(tmp_path / "t.csv")).select("a").collect()
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n" + row.replace(",", "\t") + "\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILED_READ_FILE"):
        readers.read_vocabulary_export(spark, str(tmp_path / "t.tsv")).select("a").collect()


def test_text_rows_in_a_frame(spark):
    lines = spark.createDataFrame([("1,\"x, \"\"y\"\"\",", 5), ("2,,z", 6)], "value string, offset int")
    got = readers.parse_text_rows(lines, ["a", "b.c", "d"])
    assert rows_of(got) == [(5, "1", 'x, "y"', None), (6, "2", None, "z")]
    assert rows_of(readers.parse_text_rows(lines.filter("offset = 0"), ["a", "b", "c"])) == []


@pytest.mark.parametrize("row", ["3,4,5", "6", None])
def test_bad_text_rows_are_refused(spark, row):
    lines = spark.createDataFrame([("1,2",), (row,)], "value string")
    with pytest.raises(Exception, match="MALFORMED|a row of text is null"):
        readers.parse_text_rows(lines, ["a", "b"]).select("a").collect()


def test_a_read_of_one_type_reads_one_folder(spark, raw, tmp_path):
    """Text rows, canonical form, stored by type: a later scan of a type prunes the others."""
    table = fixed.RAW_TABLES["hcpcsevents"]
    header, *rows = RAW[table.path].strip().split("\n")
    lines = spark.createDataFrame([(r,) for r in rows], "value string")
    part = readers.raw_events(readers.parse_text_rows(lines, header.split(",")), "hcpcsevents", table)
    other = readers.read_raw_table(spark, raw[0], "admissions", fixed.RAW_TABLES["admissions"])
    parts = {"hcpcsevents": part, "admissions": other}
    path = str(tmp_path / "events")
    stored = writers.ensure_dataset(
        spark, path, {"v": 1}, lambda: event_table.canonical_table(parts, fixed.RAW_TABLES, {}), partition_by=["event_type"])
    one = stored.filter("event_type = 'hcpcsevents'")
    assert rows_of(one, "patient_id", "hadm_id", "hcpcsevents/seq_num") == [("1", "10", 1)] and stored.count() == 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_type" in plan and "hcpcsevents)]" in plan.replace(" = hcpcsevents", " hcpcsevents")
    with pytest.raises(ValueError):
        readers.raw_events(part, "labevents", fixed.RAW_TABLES["labevents"])
