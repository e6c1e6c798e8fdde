"""Document ingest on generated JSON files (FIXTURES §2 cases)."""

import json
import os

from shiftlab.sources import ingest as ig


def _cvss31(score, typ="Primary", **kw):
    data = {"baseScore": score, "attackVector": "NETWORK", "attackComplexity": "LOW",
            "privilegesRequired": "NONE", "userInteraction": "NONE", "scope": "UNCHANGED",
            "confidentialityImpact": "HIGH", "integrityImpact": "HIGH", "availabilityImpact": "HIGH"}
    data.update(kw)
    return {"type": typ, "exploitabilityScore": 3.9, "impactScore": 5.9, "cvssData": data}


def _doc(cid, v31=None, **extra):
    d = {"id": cid, "published": "2020-01-01T00:00:00", "vulnStatus": "Analyzed",
         "metrics": {"cvssMetricV31": v31 if v31 is not None else [_cvss31(7.5)],
                     "cvssMetricV2": [{"type": "Primary", "cvssData": {"baseScore": 5.0}}]},
         "weaknesses": [{"description": [{"lang": "en", "value": "CWE-79"}]}],
         "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:acme:widget:1.0"}]}]}],
         "references": [{"url": "u", "tags": ["Exploit"]}],
         "descriptions": [{"lang": "en", "value": "hello"}]}
    d.update(extra)
    return d


def _write(dirpath, name, obj):
    with open(os.path.join(dirpath, name), "w", encoding="utf-8") as f:
        f.write(obj if isinstance(obj, str) else json.dumps(obj))


def _fixture_dir(d):
    _write(d, "CVE-2014-0001.json", _doc("CVE-2014-0001"))
    _write(d, "CVE-2016-0001.json", _doc("CVE-2016-0001", [_cvss31(5.0, "Secondary"), _cvss31(9.0)]))
    _write(d, "CVE-2017-0001.json", _doc("CVE-2017-0001", [_cvss31(6.9, "Secondary")]))
    for i, s in enumerate([7.0, 4.0, 3.9], start=1):
        _write(d, f"CVE-2018-000{i}.json", _doc(f"CVE-2018-000{i}", [_cvss31(s)]))
    _write(d, "CVE-2019-0001.json", _doc("CVE-2019-0001", []))
    _write(d, "CVE-2019-0002.json", "{bad json")
    bare = {"id": "CVE-2020-0001", "published": "2020-05-05", "metrics": {"cvssMetricV31": [_cvss31(8.0)]}}
    _write(d, "CVE-2020-0001.json", bare)
    _write(d, "CVE-2020-0002.json", _doc("CVE-2020-0002", configurations=[{"nodes": [{"cpeMatch": [
        {"criteria": "a:b:c"}, {"criteria": "cpe:2.3:a:v1:p"}, {"criteria": "cpe:2.3:a:v2:p"},
        {"criteria": "cpe:2.3:o:v1:q"}]}]}]))
    _write(d, "CVE-2020-0003.json", _doc("CVE-2020-0003", weaknesses=[
        {"description": [{"lang": "es", "value": "CWE-1"}, {"lang": "en", "value": "CWE-20"}]},
        {"description": [{"lang": "en", "value": "NVD-CWE-noinfo"}, {"lang": "en", "value": "other"}]}]))
    _write(d, "CVE-2020-0004.json", _doc("CVE-2020-0004", descriptions=[
        {"lang": "es", "value": "hola amigo"}, {"lang": "en", "value": "héllo"}]))
    doc5 = _doc("CVE-2020-0005")
    del doc5["published"]
    _write(d, "CVE-2020-0005.json", doc5)
    _write(d, "CVE-x-0006.json", _doc("CVE-x-0006"))
    _write(d, "notes.txt", "ignored")


def test_flatten_fixture_documents(spark, tmpdir_path):
    _fixture_dir(tmpdir_path)
    flat = ig.load_documents(spark, tmpdir_path, year_min=2015)
    assert flat.columns == ig.FLAT_COLUMNS
    rows = {r["cve_id"]: r for r in flat.collect()}
    assert "CVE-2014-0001" not in rows                       # pruned by file-name year
    assert "CVE-2019-0001" not in rows                       # no v3.1 entry
    assert "CVE-x-0006" in rows                              # unparsable year kept
    assert rows["CVE-2016-0001"]["severity"] == "Critical" and rows["CVE-2016-0001"]["cvss31_score"] == 9.0
    assert rows["CVE-2017-0001"]["severity"] == "Medium"
    assert [rows[f"CVE-2018-000{i}"]["severity"] for i in (1, 2, 3)] == ["High", "Medium", "Low"]
    r1 = rows["CVE-2020-0001"]
    assert (r1["primary_cwe"], r1["num_vendors"], r1["num_references"], r1["has_exploit"], r1["desc_length"],
            r1["num_weaknesses"], r1["cvss2_score"], r1["vuln_status"]) == ("NONE", 0, 0, 0, 0, 0, 0.0, "UNKNOWN")
    assert rows["CVE-2020-0002"]["num_vendors"] == 2
    r3 = rows["CVE-2020-0003"]
    assert r3["num_weaknesses"] == 2 and r3["primary_cwe"] == "CWE-20"
    assert rows["CVE-2020-0004"]["desc_length"] == 5
    assert rows["CVE-2020-0005"]["year_published"] is None
    assert rows["CVE-2018-0001"]["year_published"] == 2020
    rep = ig.ingest_report(spark, tmpdir_path, year_min=2015)
    assert (rep.files, rep.valid, rep.malformed, rep.skipped) == (13, 11, 1, 2)


def test_max_files_and_errors(spark, tmpdir_path):
    _fixture_dir(tmpdir_path)
    files = ig.select_files(ig.list_files(spark, tmpdir_path), 2015, 3)
    want = ["CVE-2016-0001.json", "CVE-2017-0001.json", "CVE-2018-0001.json"]
    assert sorted(r["file_name"] for r in files.collect()) == want
    assert {r["cve_id"] for r in ig.load_documents(spark, tmpdir_path, 2015, 3).collect()} == {n[:-5] for n in want}
    import pytest
    with pytest.raises(FileNotFoundError):
        ig.list_files(spark, tmpdir_path + "/missing")
    empty = os.path.join(tmpdir_path, "empty")
    os.makedirs(empty)
    with pytest.raises(FileNotFoundError):
        ig.list_files(spark, empty)


def test_cache_roundtrip(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "docs")
    os.makedirs(src)
    _fixture_dir(src)
    cache = os.path.join(tmpdir_path, "cache")
    a = ig.load_data(spark, src, cache)
    b = ig.load_data(spark, src, cache)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    k = ig.kpis(b).first()
    assert k["n_rows"] == 11 and k["min_year"] == 2020


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_compacted_corpus_prunes_years(spark, tmpdir_path):
    src, out = os.path.join(tmpdir_path, "docs"), os.path.join(tmpdir_path, "compact")
    os.makedirs(src)
    _fixture_dir(src)
    ig.compact(spark, src, out)
    for year_min, most in ((2015, 0), (2018, 0), (None, 0), (2015, 3)):
        assert _rows(ig.load_compacted(spark, out, year_min, most)) == _rows(ig.load_documents(spark, src, year_min, most))
    plan = ig.load_compacted(spark, out, 2018)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(isnull(file_year" in plan and "file_year" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    before = _rows(ig.load_compacted(spark, out, None))
    _write(src, "CVE-2018-0001.json", _doc("CVE-2018-0001", [_cvss31(9.9)]))
    _write(src, "CVE-2020-0001.json", "{broken")
    ig.compact(spark, src, out, years=[2018])  # the other years' partitions stay
    after = _rows(ig.load_compacted(spark, out, None))
    assert [r for r in after if r not in before] == [r for r in after if r[0] == "CVE-2018-0001"]
    assert len(after) == len(before)


def test_cache_is_only_used_while_it_is_valid(spark, tmpdir_path):
    import glob

    src, cache = os.path.join(tmpdir_path, "docs"), os.path.join(tmpdir_path, "cache")
    os.makedirs(src)
    _fixture_dir(src)
    path = ig.cache_path(cache, 2015, 0)

    def valid():
        return ig.cache_is_valid(spark, src, path, 2015, 0)

    assert not valid()
    first = _rows(ig.load_data(spark, src, cache))
    assert valid() and _rows(ig.load_data(spark, src, cache)) == first
    assert not ig.cache_is_valid(spark, src, path, 2016, 0)  # other parameters
    _write(src, "CVE-2018-0001.json", _doc("CVE-2018-0001", [_cvss31(9.9)]))  # a changed document
    assert not valid()
    changed = _rows(ig.load_data(spark, src, cache))
    assert valid() and changed != first
    parts = sorted(glob.glob(path + "/*.parquet"))
    with open(parts[0], "r+b") as f:  # a broken part
        f.truncate(20)
    assert not valid() and _rows(ig.load_data(spark, src, cache)) == changed and valid()
    os.remove(sorted(glob.glob(path + "/*.parquet"))[0])  # a missing part
    assert not valid() and _rows(ig.load_data(spark, src, cache)) == changed


def test_documents_that_do_not_parse(spark):
    docs = spark.createDataFrame([("a", "{bad"), ("b", ""), ("c", "[]"), ("d", "null"), ("e", "{}"), ("f", None),
                                  ("g", json.dumps(_doc("x")))], "file_name string, doc string")
    raw = ig.parse(docs)
    assert [r["cve_id"] for r in ig.flatten(raw).collect()] == ["x"]
    got = ig.report(raw)
    assert got.files == 7 and got.valid == 1


def test_streaming_ingest_matches_batch(spark, tmpdir_path):
    from shiftlab.streaming import run_ingest_stream

    src = os.path.join(tmpdir_path, "docs")
    os.makedirs(src)
    _fixture_dir(src)
    out = os.path.join(tmpdir_path, "out")
    run_ingest_stream(spark, src, out, checkpoint=os.path.join(tmpdir_path, "cp"), year_min=2015)
    got = sorted(r["cve_id"] for r in spark.read.parquet(out).collect())
    want = sorted(r["cve_id"] for r in ig.load_documents(spark, src, 2015).collect())
    assert got == want
