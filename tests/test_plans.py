import io
import json
import zipfile

import pytest
from fixtures import CANDIDATES, ROLE
from pyspark.sql import functions as F

from fitspark.__main__ import main
from fitspark.backends import MockBackend, MockJudge, RateLimitError, Retry, TransientBackendError, ask, entries
from fitspark.config import ProfileValidator, Verdict, role_of, to_yaml
from fitspark.embedding import HashEmbedding
from fitspark.operators.intrinsic import candidates_of
from fitspark.operators.validate import CandidateValidator
from fitspark.plans import compile as compiling
from fitspark.plans import session
from fitspark.plans.store import Store, ensure_schema, open_store
from fitspark.schemas import CANDIDATE
from fitspark.sources import documents, sections, study
from fitspark.streaming import events

ROLE_OBJECT = role_of(ROLE)
JOB = "Example\nAbout us\n- we make things\n\nResponsibilities:\n- build services\n- run them\n\nWhat you'll bring\n- SQL and care, for many years and in many places, with people of all kinds, so that this text is long enough.\n\nLocation\n- Dublin"


def candidates(spark):
    rows = spark.createDataFrame([(f"res{i}", "text", json.dumps(c)) for i, c in enumerate(CANDIDATES)], "resume_id string, raw_text string, candidate_json string")
    return candidates_of(rows)


# ------------------------------------------------------------------ store


def test_upsert_keeps_the_later_row(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.list("workspaces").count() == 0 and s.get("workspaces", "w") is None
    for name in ("first", "second"):
        s.save("workspaces", [{"workspace_id": "w", "name": name, "created_at": "2026"}])
    assert s.get("workspaces", "w")["name"] == "second" and s.list("workspaces").count() == 1
    s.clean("workspaces")
    assert s.get("workspaces", "w")["name"] == "second"


def test_listing_is_ordered_and_isolated(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.save("profiles", [{"profile_id": p, "workspace_id": w, "created_at": t} for p, w, t in (("b", "w1", "1"), ("a", "w1", "1"), ("c", "w1", "0"), ("d", "w2", "0"))])
    assert [r["profile_id"] for r in s.list("profiles", "w1").collect()] == ["c", "a", "b"]


def test_vectors(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    row = lambda i, v, m="m-1", w="w": {"embedding_id": i, "workspace_id": w, "owner_type": "resume", "embedding_model": m, "dim": len(v), "vector": [float(x) for x in v]}
    s.save("embeddings", [row("e1", [1, 0, 0]), row("e2", [0, 1, 0]), row("e3", [1, 0, 0], m="other"), row("e4", [1, 0]), row("e5", [1, 0, 0], w="v")])
    found = lambda **o: [r["embedding_id"] for r in s.search([0.9, 0.1, 0.0], model="m-1", **o).collect()]
    assert found() == ["e1", "e5", "e2"] and found(workspace_id="w", top_k=1) == ["e1"] and found(owner_type="job") == []
    assert s.search([1.0], model="m-1").count() == 0
    with pytest.raises(Exception, match="has not the length"):
        s.save("embeddings", [row("bad", [1, 0]) | {"dim": 3}])


def test_tables_are_created_once(spark):
    names = ensure_schema(spark, "fit_test")
    assert ensure_schema(spark, "fit_test") == names == ["workspaces", "profiles", "resumes", "candidate_records", "fit_runs", "corrections", "embeddings"]
    assert {r["tableName"] for r in spark.sql("SHOW TABLES IN fit_test").collect()} >= set(names)
    assert spark.table("fit_test.embeddings").schema["vector"].dataType.simpleString() == "array<double>"
    spark.sql("DROP DATABASE fit_test CASCADE")


def test_commands_compile_and_compare(spark, tmp_path, capsys):
    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs" / "one.txt").write_text(JOB)
    for i, extra in enumerate(({}, {"red_flags": {}})):
        (tmp_path / f"{i}.yaml").write_text(to_yaml(ROLE | extra))
    assert main(["parity", str(tmp_path / "0.yaml"), str(tmp_path / "1.yaml")]) == 0
    assert json.loads(capsys.readouterr().out)["signal_count_delta"] == 0
    assert main(["compile-roles", str(tmp_path / "jobs"), str(tmp_path / "roles")]) == 0
    assert spark.read.json(str(tmp_path / "roles")).first()["jd_slug"] == "one"
    assert main(["compile-candidates", str(tmp_path / "jobs"), str(tmp_path / "people")]) == 0
    assert spark.read.json(str(tmp_path / "people")).first()["resume_id"] == "one"


def test_search_reads_one_model_and_length(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    row = lambda i, model, v: {"embedding_id": i, "workspace_id": "w", "owner_type": "t", "owner_id": "o", "embedding_model": model, "dim": len(v), "vector": v, "created_at": "1"}
    s.save("embeddings", [row("a", "m/1", [1.0, 0.0]), row("b", "m/1", [0.0, 1.0]), row("a", "m2", [1.0, 0.0]), row("c", "m/1", [1.0, 0.0, 0.0])])
    s.save("embeddings", [row("a", "m2", [0.0, 1.0])])
    got = s.search([1.0, 0.0], model="m/1")
    assert [r["embedding_id"] for r in got.collect()] == ["a", "b"]  # the later version of the other model's vector changes nothing
    assert "PartitionFilters: [isnotnull(_model" in got._jdf.queryExecution().executedPlan().toString()


def test_clean_keeps_what_is_saved_meanwhile(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path))
    row = lambda i, name: {"workspace_id": i, "name": name, "created_at": "1", "updated_at": "1"}
    s.clean("workspaces")
    for name in ("x", "y"):
        s.save("workspaces", [row("w1", name), row("w2", "z")])
    append = Store._append

    def late(self, rows, table, folder):
        append(self, rows, table, folder)
        if folder != "v0":  # a save that began before the list was replaced
            monkeypatch.setattr(Store, "_append", append)
            s.save("workspaces", [row("w3", "late")])

    monkeypatch.setattr(Store, "_append", late)
    s.clean("workspaces")
    want = {("w1", "y"), ("w2", "z"), ("w3", "late")}
    got = lambda: {(r["workspace_id"], r["name"]) for r in s.read("workspaces").collect()}
    assert got() == want and s._versions("workspaces").count() == 3
    s.clean("workspaces")
    s.clean("workspaces")
    assert got() == want and len(s._folders("workspaces")) <= 2
    s.save("workspaces", [row("w1", "new")])
    assert s.get("workspaces", "w1")["name"] == "new"


def test_store_by_configuration(spark, tmp_path, monkeypatch):
    assert open_store(spark, {"path": str(tmp_path)}).path == str(tmp_path)
    monkeypatch.setenv("STORE_BACKEND", "memory")
    assert "session-" in open_store(spark).path
    with pytest.raises(ValueError, match="unknown store backend"):
        open_store(spark, {"backend": "tape"})


# ------------------------------------------------------------------ sessions


def test_fit_is_stored_for_valid_candidates_only(spark, tmp_path, write):
    good = {"company_size": "51-200"}
    rows = candidates(spark)
    filled = rows.withColumn("profile", *[F.col("profile").withField("current_title", F.lit("x")).withField("current_company", F.lit("x")).withField("current_industry", F.lit("x")).withField("current_company_size", F.lit(good["company_size"]))])
    broken = filled.withColumn("signals", F.when(F.col("candidate_id") == "WEAK", F.col("signals").withField("notice_period_days", F.lit(999))).otherwise(F.col("signals")))
    store = Store(spark, str(tmp_path / "store"))
    done = session.run_fit(broken, ROLE_OBJECT, HashEmbedding(), store, write, workspace_id="w", profile_id="p", profile_yaml=to_yaml(ROLE))
    got = {r["candidate_id"]: (r["status"], [v["path"] for v in r["violations"]]) for r in done.collect()}
    assert got == {"STRONG": ("ok", []), "BORDERLINE": ("ok", []), "WEAK": ("invalid", ["signals.notice_period_days"])}
    runs = store.list("fit_runs", "w").collect()
    assert len(runs) == 2 and store.list("resumes", "w").count() == 2 and store.list("candidate_records", "w").count() == 2
    assert set(json.loads(runs[0]["result_json"])) == {"overall", "candidate_id", "role_title", "per_signal", "gates", "red_flags", "gaps"}
    # Ids agree between the tables.
    assert store.read("fit_runs").join(store.read("candidate_records"), "record_id").count() == 2


def test_corrections(spark):
    before = candidates(spark)
    after = before.withColumn("profile", F.col("profile").withField("location", F.lit("Elsewhere")))
    rows = session.corrections(before.where("resume_id = 'res0'"), after.where("resume_id = 'res0'"), workspace_id="w").collect()
    assert [(r["resume_id"], r["field_path"], r["before_json"], r["after_json"]) for r in rows] == [("res0", "profile.location", "Bengaluru", "Elsewhere")]


def test_editing_round_trip(spark):
    c = candidates(spark)
    rows = session.to_rows(c, "career_history")
    blank = rows.limit(1).withColumn("pos", F.lit(99)).withColumn("company", F.lit(" ")).withColumn("title", F.lit(None).cast("string"))
    again = session.from_rows(rows.unionByName(blank), "career_history", named=("company", "title"))
    joined = c.select("candidate_id", F.col("career_history").alias("old")).join(again, "candidate_id")
    assert joined.count() == 3 and joined.where("not (old <=> career_history)").count() == 0


# ------------------------------------------------------------------ backends


class Flaky:
    def __init__(self, *answers):
        self.answers, self.last_usage = list(answers), None

    def generate(self, *a, **k):
        x = self.answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x


def tried(*answers):
    waits = []
    model = Flaky(*answers)
    return Retry(sleep=waits.append), model, waits


def test_transient_errors_are_tried_again():
    retry, model, waits = tried(RuntimeError("503 UNAVAILABLE"), "", "fine")
    assert retry(lambda: model.generate("x")) == "fine" and len(waits) == 2 and 0.8 <= waits[0] <= 1.05 and 1.6 <= waits[1] <= 1.85


def test_rate_limits_and_other_errors_are_not():
    for error, kind in ((RuntimeError("429 RESOURCE_EXHAUSTED"), RateLimitError), (RuntimeError("400 bad"), RuntimeError)):
        retry, model, waits = tried(error, "fine")
        with pytest.raises(kind):
            retry(lambda m=model: m.generate("x"))
        assert not waits
    retry, model, waits = tried(*[RuntimeError("500")] * 3)
    with pytest.raises(TransientBackendError):
        retry(lambda: model.generate("x"))
    assert len(waits) == 2


def test_asking(spark):
    prompts = spark.createDataFrame([(1, "profile please", "p"), (2, "other", "o"), (3, None, "n")], "i int, prompt string, leaf string")
    got = {r["i"]: r for r in ask(prompts, MockBackend({"profile": '{"a": 1}', "other": "no json"})).collect()}
    assert got[1]["answer"] == '{"a": 1}' and got[1]["ok"] and got[1]["tries"] == 1 and got[2]["tries"] == 2 and got[3]["answer"] == "{}"
    failed = ask(prompts, MockBackend(error="429")).collect()
    assert all(not r["ok"] and r["error"].startswith("RateLimitError") and r["answer"] is None for r in failed)
    shown = entries(ask(spark.createDataFrame([("x" * 500, "l")], "prompt string, leaf string"), MockBackend())).first()
    assert len(shown["prompt"]) == 401 and shown["prompt"].endswith("…")


def test_judges(spark):
    pairs = spark.createDataFrame([("j", "strong", "job", "Designed and led work, 5 years of experience"), ("j", "weak", "job", "Office clerk, filing")], "jd_slug string, tier string, jd_text string, resume_text string")
    engine = spark.createDataFrame([("j", "strong", 80.0)], "jd_slug string, tier string, score double")
    got = session.run_study(pairs, engine, MockJudge(), repeats=2)
    rows = got.collect()
    assert len(rows) == 12 and {r["method"] for r in rows} == {"engine", "rubric", "naive"}
    by = {(r["method"], r["tier"]): r for r in rows}
    assert by["rubric", "strong"]["score"] > by["rubric", "weak"]["score"] and by["engine", "weak"]["error"] == "not scored" and by["naive", "weak"]["tokens"] > 0


# ------------------------------------------------------------------ compilation

GOOD = {
    '"profile"': json.dumps({"profile": {"anonymized_name": "A", "years_of_experience": "5", "current_company_size": "huge"}, "projects": ["Robot", " "]}),
    '"career_history"': "Here:\n```json\n" + json.dumps({"career_history": [{"title": "Engineer", "company": "F", "start_date": "2020-1-5", "end_date": "2021-01-05"}, {"title": "Lead", "company": "G", "start_date": "2021-02-01", "end_date": "present"}]}) + "\n```",
    '"skills"': json.dumps({"skills": [{"name": "SQL", "proficiency": "EXPERT", "endorsements": 2.5}, {"name": "sql"}, {"name": ""}, {"name": "Go", "duration_months": 7}]}),
    '"education"': json.dumps({"education": [{"institution": "U", "start_year": 1900, "end_year": 1899}]}),
}


def test_compiled_candidates(spark, write):
    texts = spark.createDataFrame([("r1", "Robot builder. 30 days notice. github.com/robot")], "resume_id string, text string")
    r = compiling.compile_candidates(texts, MockBackend(GOOD), write).first()
    assert r["candidate_id"].startswith("CAND_") and not r["violations"] and "signals" in r["defaulted"] and "profile" not in r["defaulted"]
    assert r["profile"]["years_of_experience"] == 5 and r["profile"]["current_company_size"] == "201-500" and r["profile"]["summary"] == "Projects: robot" and r["profile"]["anonymized_name"] == "A" and r["profile"]["country"] == "India"
    assert [(j["title"], j["start_date"], j["end_date"], j["duration_months"], j["is_current"]) for j in r["career_history"]] == [("Engineer", "2020-01-05", "2021-01-05", 12, False), ("Lead", "2021-02-01", None, 64, True)]
    assert [(s["name"], s["proficiency"], s["endorsements"], s["duration_months"]) for s in r["skills"]] == [("SQL", "intermediate", 2, None), ("Go", "intermediate", 0, 7)]
    assert (r["education"][0]["start_year"], r["education"][0]["end_year"]) == (1970, 1970)
    s = r["signals"]
    assert (s["notice_period_days"], s["github_activity_score"], s["recruiter_response_rate"], s["last_active_date"], s["signup_date"]) == (30, 40.0, 0.5, "2026-06-06", "2025-06-06") and len(s) == 23


@pytest.mark.parametrize("backend", [MockBackend(), MockBackend({"": "useless"}), MockBackend(error="429"), MockBackend({"": '{"career_history": 5, "skills": "x"}'})], ids=["empty", "useless", "limited", "wrong"])
def test_candidates_are_always_valid(spark, write, backend):
    texts = spark.createDataFrame([("r1", "text"), ("r2", None)], "resume_id string, text string")
    rows = session.parse_resumes(texts, backend, write).collect()
    assert len(rows) == 2 and all(not r["violations"] and r["career_history"] and r["defaulted"] for r in rows)
    assert {r["status"] for r in rows} == ({"rate_limited"} if backend.error else {"ok"})


def test_only_the_failing_part_is_asked_again(spark, write, monkeypatch):
    no_skills = lambda: F.when(F.size("skills") == 0, F.array(F.struct(F.lit("skills").alias("path"), F.lit("none").alias("message")))).otherwise(F.expr("cast(array() as array<struct<path:string,message:string>>)"))
    monkeypatch.setattr(compiling, "candidate_violations", no_skills)
    texts = spark.createDataFrame([("r1", "text")], "resume_id string, text string")
    answers = {"broke these rules: skills none": '{"skills": [{"name": "SQL"}]}', '"profile"': json.dumps({"profile": {"anonymized_name": "kept"}})}
    r = compiling.compile_candidates(texts, MockBackend(answers), write).first()
    assert [s["name"] for s in r["skills"]] == ["SQL"] and r["profile"]["anonymized_name"] == "kept" and "skills" not in r["defaulted"]
    assert sorted(c["leaf"] for c in r["calls"]) == sorted([*(p.name for p in compiling.CANDIDATE_PARTS), "skills"])
    r = compiling.compile_candidates(texts, MockBackend(), write, max_repairs=2).first()  # no answer helps
    assert [c["leaf"] for c in r["calls"]].count("skills") == 4 and len(r["calls"]) == 8 and r["violations"]


def test_details_of_the_first_signals(spark, write):
    labels = [{"label": f"need {i}", "dense_weight": 0.3} for i in range(9)]
    answers = {"Requirement: need 2": '{"query": "find two", "evidence_regex": "two", "dense_weight": 0.9}', "Requirement: need 3": '{"dense_weight": -4}', '"signals"': json.dumps({"signals": labels})}
    texts = spark.createDataFrame([("j", JOB)], "jd_slug string, text string")
    for most, asked in ((7, 7), (3, 3), (0, 0)):
        r = compiling.compile_roles(texts, MockBackend(answers), write, max_signal_detail=most).first()
        assert sum(c["leaf"].startswith("detail:") for c in r["calls"]) == asked and len(r["signals"]) == 9
        if most == 7:
            assert (r["signals"][2]["query"], r["signals"][2]["evidence_regex"], r["signals"][2]["dense_weight"]) == ("find two", "two", 0.9)
            assert (r["signals"][3]["query"], r["signals"][3]["dense_weight"], r["signals"][8]["query"]) == ("need 3", 0.0, "need 8")


def test_the_formula_tells_tiers_of_made_resumes_apart(spark):
    from fitspark.plans.workflows import study_scores

    rows = study_scores(spark, "/root/testdata/sf0.001").where("method = 'engine'").groupBy("tier").agg(F.avg("score").alias("s"), F.count_if(F.col("error").isNotNull()).alias("n")).collect()
    means = {r["tier"]: r["s"] for r in rows}
    assert means["strong"] > means["borderline"] > means["weak"] and not any(r["n"] for r in rows)


def test_validators_name_the_field(spark, write):
    assert ProfileValidator().validate(ROLE) == Verdict(True)
    got = ProfileValidator().validate(ROLE | {"role": ROLE["role"] | {"title": " "}})
    assert (got.ok, got.field, got.top) == (False, "role.title", "role") and "empty" in got.error
    check = CandidateValidator(spark, check_id=False)
    made = compiling.compile_candidates(spark.createDataFrame([("r", "text")], "resume_id string, text string"), MockBackend(), write)
    whole = json.loads(made.select(F.to_json(F.struct(*(c for c in CANDIDATE.fieldNames() if c in made.columns)))).first()[0])
    assert check.validate(whole).ok
    got = check.validate(whole | {"career_history": []})
    assert not got.ok and got.top == "career_history" and got.error.startswith("field 'career_history")


def test_compiled_roles(spark, write):
    answers = {'"signals"': json.dumps({"signals": [{"label": "SQL & care", "evidence_regex": "sql"}, {"label": "SQL, care", "dense_weight": -1, "evidence_regex": "("}]}), '"red_flags"': json.dumps({"red_flags": {"cv_primary": True, "other": 1}}), '"domain"': json.dumps({"domain": {"in_domain_terms": ["C++ ", "Data"]}})}
    texts = spark.createDataFrame([("j", JOB)], "jd_slug string, text string")
    for backend in (MockBackend(answers), MockBackend({"": "nothing"})):
        r = compiling.compile_roles(texts, backend, write).first()
        role, mended = compiling.checked_role(json.loads(r["profile_json"]))
        assert role.signals and role.title == "Example"
        if backend.answers is answers:
            assert [(s.id, s.evidence_regex, s.dense_weight) for s in role.signals] == [("sql_care", "sql", 0.1), ("sql_care_2", None, 0.0)] and mended == ["signals.sql_care_2"]
            assert role.flags == {"cv_primary", "job_hopper", "stale_ic_role"} and role.in_terms == ("c++", "data") and role.in_regex == r"c\+\+|data"
        else:
            assert len(r["defaulted"]) == 6


# ------------------------------------------------------------------ sources


def test_sections(spark):
    rows = sections.with_sections(spark.createDataFrame([(JOB,), ("no headers here at all",), (None,)], "text string"))
    got = rows.select("sections", sections.snippet("text", "location", head=10).alias("s")).collect()
    assert set(got[0]["sections"]) == {"about", "responsibilities", "qualifications", "location"}
    assert got[0]["sections"]["responsibilities"] == "- build services\n- run them" and got[0]["s"] == JOB
    assert got[1]["sections"] == {} and got[1]["s"] == "no headers here at all" and got[2]["s"] == ""


def docx(*paragraphs):
    ns = documents.WORD_NS[1:-1]
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Grüße\xff".encode("latin-1") + "ü".encode())
    (tmp_path / "b.docx").write_bytes(docx("one", "two"))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d").write_bytes(b"%PDF-1.4 nothing")
    got = {r["path"].rsplit("/", 1)[1]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"]["text"] == "Greü"
    assert got["b.docx"]["text"] == "one\ntwo" and got["c.docx"]["text"] is None and got["c.docx"]["error"]
    assert got["d"]["kind"] == "pdf"


def test_routing(spark):
    urls = ["https://boards.greenhouse.io/firm/jobs/12?x", "https://www.amazon.jobs/en/jobs/77/x", "https://x.org/1"]
    rows = documents.routed(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert [(r["board"], r["job_key"]) for r in rows] == [("greenhouse", "firm/jobs/12"), ("amazon", "77"), ("page", None)]
    shared = spark.createDataFrame([("https://docs.google.com/document/d/AbC-1/edit",), ("x",)], "u string").select(documents.shared_document_url(F.col("u"))).collect()
    assert [r[0] for r in shared] == ["https://docs.google.com/document/d/AbC-1/export?format=txt", None]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"slug": "a", "url": "https://x.org/a"}, {"slug": "b", "url": "https://amazon.jobs/en/jobs/9"}, {"slug": "c", "url": "https://x.org/c"}]))
    jobs = documents.read_manifest(spark, str(tmp_path / "m.json"), ["a", "b"])
    pages = spark.createDataFrame([("https://x.org/a", "<p>Text</p>")], "url string, html string")
    got = {r["slug"]: (r["board"], r["text"], r["error"]) for r in documents.job_texts(jobs, pages).collect()}
    assert got == {"a": ("page", "Text", None), "b": ("amazon", None, "no page or no text")}


def test_sql_functions(spark):
    from fitspark.functions.register import register

    assert len(register(spark)) == 8
    row = spark.sql("SELECT fit_clip(5, 0, 3) a, fit_months(date '2022-12-01', date '2026-06-06') b, fit_tidy(' A  b ') c, fit_overlap(array('x'), array('x', 'y')) d, fit_cosine(array(1D, 0D), array(2D, 0D)) e, fit_half_life(18, 18) f").first()
    assert (row["a"], row["c"], row["d"], row["e"], row["f"]) == (3.0, "a b", 0.5, 1.0, 0.5) and row["b"] == pytest.approx(42 + 5 / 30)


def test_made_resumes_and_discovery(spark, tmp_path):
    jobs = spark.createDataFrame([("acme_engineer", "Engineer", ["SQL", "Go"])], "jd_slug string, title string, skills array<string>")
    made = study.make_resumes(jobs)
    texts = {r["tier"]: r["text"] for r in made.collect()}
    assert texts == {r["tier"]: r["text"] for r in study.make_resumes(jobs.repartition(3)).collect()} and len(texts) == 3
    for tier, text in texts.items():
        folder = tmp_path / "resumes" / f"acme_engineer_{tier}" / ("single_column" if tier == "weak" else "")
        folder.mkdir(parents=True)
        (folder / "resume.txt").write_text(text)
    for name in ("jd.txt", "jd_profile.yaml"):
        (tmp_path / "jobs" / "acme_engineer").mkdir(parents=True, exist_ok=True)
        (tmp_path / "jobs" / "acme_engineer" / name).write_text("x")
    found = study.discover_dataset(spark, str(tmp_path / "resumes"), str(tmp_path / "jobs")).collect()
    assert [(r["jd_slug"], r["tier"]) for r in found] == [("acme_engineer", t) for t in ("borderline", "strong", "weak")]
    assert [r["jd_slug"] for r in study.job_slugs(spark, str(tmp_path / "jobs")).collect()] == ["acme_engineer"]
    dated = made.select(study.dated_entries(study.resume_entries(F.col("text")), F.to_date(F.lit("2026-06-06"))).alias("e")).first()["e"]
    assert len(dated) == 1 and dated[0]["end_date"] is None


# ------------------------------------------------------------------ streams


def run(query, spark, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("complete" if "totals" in name else "append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


@pytest.fixture(scope="module")
def event_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(path)
    return path


def test_windows_of_a_stream_are_those_of_a_batch(spark, event_dir):
    batch = spark.read.parquet(event_dir)
    stream = run(events.windowed(events.read_stream(spark, event_dir, batch.schema, files_per_trigger=100), late="0 seconds"), spark, "windows")
    want = {tuple(r) for r in events.windowed(batch).collect()}
    got = {tuple(r) for r in stream.collect()}
    assert got and got <= want  # the last windows stay open until later events come


def test_stream_totals_and_duplicates(spark, event_dir):
    batch = spark.read.parquet(event_dir)
    twice = events.read_stream(spark, event_dir, batch.schema)
    assert run(events.first_seen(twice, late="10000 days"), spark, "first").count() == batch.count()
    calls = lambda df: df.select(F.lit(1).alias("tokens"), F.col("value").alias("elapsed_s"), F.lit(None).cast("string").alias("error"))
    assert run(events.progress(calls(twice)), spark, "totals").first()["n_calls"] == batch.count()
    assert events.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_scoring_a_stream(spark, tmp_path):
    spark.createDataFrame([(json.dumps(c),) for c in CANDIDATES], "candidate_json string").write.parquet(str(tmp_path / "in"))
    arriving = events.read_stream(spark, str(tmp_path / "in"), "candidate_json string")
    from fitspark.operators.score import score_candidates

    q = events.score_stream(arriving, lambda df: score_candidates(candidates_of(df), ROLE_OBJECT, HashEmbedding()).select("candidate_id", "overall"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = {r["candidate_id"]: r["overall"] for r in score_candidates(candidates(spark).drop("resume_id", "raw_text"), ROLE_OBJECT, HashEmbedding()).collect()}
    assert {r["candidate_id"]: r["overall"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_study_scores_cover_all_jobs(spark, tmp_path):
    from fitspark.plans import workflows

    parts = [(k, f"type {k % 7}", f"brand {k % 5}", f"name {k}") for k in range(1, 81)]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_brand string, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = workflows.study_scores(spark, str(tmp_path)).groupBy("jd_slug").count().collect()
    assert {r["jd_slug"] for r in got} == {f"job{k}" for k in range(1, 81)} and {r["count"] for r in got} == {3 * 3 * 2}


def test_made_resumes_are_spread(spark, tmp_path):
    from fitspark.plans import workflows

    rows = spark.range(12_001).selectExpr("id AS p_partkey", "'type' AS p_type", "'brand' AS p_brand", "'name' AS p_name")
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    made = workflows.made_resumes(spark, str(tmp_path))
    sizes = made.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 3 and sum(r["count"] for r in sizes) == 3 * 12_001 and max(r["count"] for r in sizes) < 3 * 5_000
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()


def test_resume_fields_are_read_by_several_tasks(spark, tmp_path):
    from fitspark.plans import workflows

    rows = spark.range(10_001).selectExpr("id AS p_partkey", "'type' AS p_type", "'brand' AS p_brand", "'name' AS p_name")
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert workflows.resume_fields(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_what_resumes_state_is_searched_for_once(spark):
    from fitspark.sources import study

    made = ["SUMMARY\nx\nEDUCATION\nBSc,  City, 2010, more\nSKILLS\na", "EDUCATION\nBSc, City\n5 days notice", "EDUCATION\nBSc, City, x\n999 days notice", "2 months notice; immediate joiner", "Immediately available", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(made)], "i int, text string")
    c = study.candidates_of_resumes(rows, ref=F.lit("2026-06-06").cast("date"), key=F.col("i").cast("string"))
    out = c.select("i", "profile.summary", "education.degree", "education.institution", "education.end_year", "signals.notice_period_days", "career_history")
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert [plan.count(x) for x in (r"\n)SUMMARY\n(", r"\n)EDUCATION\n(", "days?", "months?", "joiner")] == [1] * 5
    got = [tuple(x)[1:6] for x in out.orderBy("i").collect()]
    assert got == [("x", ["BSc"], [" City"], [2010], None), ("", [], [], [], 5), ("", [], [], [], 180), ("", [], [], [], 60), ("", [], [], [], 0), ("", [], [], [], None), ("", [], [], [], None)]


def test_customers_are_compiled_by_several_tasks(spark, tmp_path, monkeypatch):
    from fitspark.plans import workflows

    rows = spark.range(1, 10_002).selectExpr("id AS c_custkey", "'M' AS c_mktsegment")
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    seen = []

    def compiled(texts, *args, **kwargs):
        seen.append(texts.rdd.getNumPartitions())
        raise InterruptedError

    monkeypatch.setattr(workflows, "compile_candidates", compiled)
    monkeypatch.setattr(workflows, "parse_resumes", compiled)
    for query in (workflows.compiled_candidates, workflows.mended_candidates, workflows.typed_outcomes):
        with pytest.raises(InterruptedError):
            query(spark, str(tmp_path))
    assert seen == [3, 3, 3]


def test_positions_beyond_the_most_are_not_coerced(spark):
    from fitspark.operators import coerce

    job = lambda k: {"title": f"t{k}", "start_date": "2020-1-5", "end_date": "2021-01-05" if k else "Present", "duration_months": -1}
    answers = [json.dumps({"career_history": x}) for x in ([job(k) for k in range(12)], [1, "x", job(3)], [], 5, [{"end_date": "2019-02-30", "is_current": False}])]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    got = {r["i"]: r["c"] for r in rows.select("i", coerce.career(F.try_parse_json("a"), F.to_date(F.lit("2026-06-06"))).alias("c")).collect()}
    assert [(j["title"], j["end_date"], j["duration_months"], j["is_current"]) for j in got[0]][:2] == [("t0", None, 77, True), ("t1", "2021-01-05", 12, False)] and len(got[0]) == 10
    assert [j["title"] for j in got[1]] == ["t3"] and [len(got[i]) for i in (2, 3, 4)] == [1, 1, 1]
    assert got[2] == got[3] and got[2][0]["description"] == "Unknown Title at Unknown Company." and got[2][0]["is_current"] and got[4][0]["end_date"] is None and got[4][0]["is_current"]
