"""Labelled data sets, study results and made-up résumés."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitspark.functions import arrays, text
from fitspark.schemas import CANDIDATE, SCORES

TIER_DIR = r"^(.+)_(strong|borderline|weak)$"


def files_under(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(folder, parent, path) of the files of a name at any depth."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path).select("path")
    parts = F.split(F.col("path"), "/")
    return found.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -3).alias("parent"))


def pair_files(resumes: DataFrame, texts: DataFrame, profiles: DataFrame, *, layout: str = "single_column") -> DataFrame:
    """(jd_slug, tier, resume_path), ordered by folder name, from listings of files (path, folder, parent).

    A résumé is the file in the layout's folder, else the flat one; its job needs a text and a profile.
    """
    flat = resumes.where(F.col("folder").rlike(TIER_DIR)).select(F.col("folder").alias("name"), F.col("path").alias("flat"))
    laid = resumes.where((F.col("folder") == layout) & F.col("parent").rlike(TIER_DIR)).select(F.col("parent").alias("name"), F.col("path").alias("laid"))
    pairs = flat.join(laid, "name", "full").select("name", F.regexp_extract("name", TIER_DIR, 1).alias("jd_slug"), F.regexp_extract("name", TIER_DIR, 2).alias("tier"), F.coalesce("laid", "flat").alias("resume_path"))
    for needed in (texts, profiles):
        pairs = pairs.join(needed.select(F.col("folder").alias("jd_slug")), "jd_slug", "left_semi")
    return pairs.orderBy("name").select("jd_slug", "tier", "resume_path")


def discover_dataset(spark: SparkSession, resumes: str, jobs: str, *, layout: str = "single_column", limit: int | None = None) -> DataFrame:
    """pair_files() of the files under two paths."""
    out = pair_files(files_under(spark, resumes, "resume.txt"), files_under(spark, jobs, "jd.txt"), files_under(spark, jobs, "jd_profile.yaml"), layout=layout)
    return out.limit(limit) if limit is not None else out


def job_slugs(spark: SparkSession, jobs: str) -> DataFrame:
    return files_under(spark, jobs, "jd_profile.yaml").select(F.col("folder").alias("jd_slug")).distinct().orderBy("jd_slug")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Study scores from CSV; empty cells are null."""
    return spark.read.schema(SCORES).option("header", True).csv(path)


def write_scores(study: DataFrame, path: str, *, files: int | None = None) -> None:
    """Study scores as CSV, a file for each task, or `files` of them: four decimals, null as an empty cell."""
    study = study if files is None else study.coalesce(files)
    four = lambda c: F.format_string("%.4f", F.col(c).cast("double")).alias(c)
    study.select("jd_slug", "tier", "method", "repeat", four("score"), F.col("tokens").cast("string").alias("tokens"), four("elapsed_s"), "error").write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def eval_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run folders that have scores, newest name first."""
    return files_under(spark, path, "*.csv").select(F.col("folder").alias("run")).distinct().orderBy(F.desc("run"))


# ------------------------------------------------------------------ made-up résumés

FIRMS = ("Northwind", "Bluefield", "Harborline", "Stonebridge", "Maplecroft", "Ironwood", "Clearwater", "Redhill")
SCHOOLS = ("State University", "City College", "Institute of Technology")


def make_resumes(jobs: DataFrame) -> DataFrame:
    """Three résumés, one of each tier, for each job (jd_slug, title, skills array), the same on every run; the job's other columns come last.

    Choices are hashes of slug and tier, so they depend on neither process nor order.
    """
    rows = jobs.withColumn("tier", F.explode(F.array(F.lit("strong"), F.lit("borderline"), F.lit("weak"))))
    seed = lambda salt: F.pmod(F.xxhash64("jd_slug", "tier", F.lit(salt)), F.lit(1 << 30))
    pick = lambda of, salt: F.get(F.array(*(F.lit(x) for x in of)), (seed(salt) % len(of)).cast("int"))
    by_tier = lambda a, b, c: F.when(F.col("tier") == "strong", a).when(F.col("tier") == "borderline", b).otherwise(c)
    years = by_tier(5 + seed("y") % 4, 2 + seed("y") % 2, 1 + seed("y") % 6)
    skills: Column = by_tier(F.col("skills"), F.slice("skills", 1, 2), F.array(F.lit("Filing"), F.lit("Scheduling")))
    title = by_tier(F.col("title"), F.concat(F.lit("Junior "), F.col("title")), F.lit("Office Clerk"))
    did = by_tier(F.concat(F.lit("Designed and led work with "), F.array_join("skills", ", "), F.lit(".")), F.concat(F.lit("Helped with "), F.array_join(F.slice("skills", 1, 2), ", "), F.lit(".")), F.lit("Kept files and calendars."))
    y = years.cast("string")
    body = F.concat_ws(
        "\n",
        F.lit("SUMMARY"), F.concat(title, F.lit(" with "), y, F.lit(" years of experience.")),
        F.lit("EXPERIENCE"), F.concat(title, F.lit(", "), pick(FIRMS, "f"), F.lit(" ("), y, F.lit(" years, Present)")), F.concat(F.lit("- "), did),
        F.lit("PROJECTS"), F.concat(F.lit("- A project with "), F.coalesce(F.get(skills, F.lit(0)), F.lit("paper"))),
        F.lit("EDUCATION"), F.concat(F.lit("BSc, "), pick(SCHOOLS, "s"), F.lit(", "), (2008 + seed("e") % 10).cast("string")),
        F.lit("SKILLS"), F.array_join(skills, ", "),
        F.concat(by_tier(F.lit(15), F.lit(60), F.lit(120)).cast("string"), F.lit(" days notice")),
    )
    return rows.select("jd_slug", "tier", body.alias("text"), *(c for c in jobs.columns if c not in ("jd_slug", "title", "skills", "tier", "text")))


ENTRY = r"(?m)^(.+?), (.+?) \((\d+) years?, (Present|\+\d+y)\)$"
BLOCK = r"(?m)^[^\n]+, [^\n]+ \(\d+ years?, (?:Present|\+\d+y)\)$(?:\n- [^\n]*)*"


def resume_section(c: Column, name: str) -> Column:
    """What stands under a heading in capitals, up to the next; empty without one."""
    return F.trim(F.regexp_extract(c, rf"(?s)(?:^|\n){name}\n(.*?)(?=\n(?:SUMMARY|EXPERIENCE|PROJECTS|EDUCATION|SKILLS)\n|$)", 1))


def resume_entries(c: Column) -> Column:
    """Positions in a made-up résumé, in order: title, firm, months, whether it goes on, and what was done."""
    blocks = F.regexp_extract_all(c, F.lit(BLOCK), F.lit(0))
    take = lambda x, i: F.regexp_extract(x, ENTRY, i)
    did = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[^\n]*\n?", ""), r"(?m)^- ", "")
    return F.transform(blocks, lambda x: F.struct(take(x, 1).alias("title"), take(x, 2).alias("company"), (take(x, 3).cast("int") * 12).alias("months"), (take(x, 4) == "Present").alias("is_current"), F.replace(did(x), F.lit("\n"), F.lit(" ")).alias("description")))


def candidates_of_resumes(resumes: DataFrame, *, ref: Column, key: Column, column: str = "text") -> DataFrame:
    """Candidates as made-up résumés state them, without a model; other columns stay before them.

    What a résumé does not state is null. Positions are dated backwards from `ref`.
    """
    t = F.coalesce(F.col(column), F.lit(""))
    # Three parts without commas, or an empty one.
    school = F.split(F.regexp_extract(resume_section(t, "EDUCATION"), r"^[^,\n]+, [^,\n]+, \d{4}", 0), ", ")
    part = lambda i: F.get("_school", F.lit(i))
    first_line = F.get(F.split(resume_section(t, "SKILLS"), "\n"), F.lit(0))
    names = F.filter(F.transform(F.split(first_line, ","), lambda x: F.trim(x)), lambda x: x != "")

    def members(kind, have: dict[str, Column]) -> Column:
        return F.struct(*(have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))

    of = lambda name: CANDIDATE[name].dataType.elementType
    date = lambda d: F.date_format(d, "yyyy-MM-dd")
    job = lambda e: members(of("career_history"), {"title": e["title"], "company": e["company"], "start_date": date(e["start_date"]), "end_date": date(e["end_date"]), "duration_months": e["months"], "is_current": e["end_date"].isNull(), "description": e["description"]})
    # What is used more than once is a column: in an expression it would be searched for again at each use.
    rows = resumes.withColumns({"_jobs": dated_entries(resume_entries(t), ref), "_summary": resume_section(t, "SUMMARY"), "_school": school})
    made = {
        "candidate_id": key,
        "profile": members(CANDIDATE["profile"].dataType, {"headline": F.get(F.split("_summary", "\n"), F.lit(0)), "summary": F.col("_summary"), "years_of_experience": text.years_claimed(t), "current_title": F.get("_jobs", F.lit(0))["title"], "current_company": F.get("_jobs", F.lit(0))["company"]}),
        "career_history": F.transform("_jobs", job),
        "education": F.when(F.size("_school") == 3, F.array(members(of("education"), {"degree": part(0), "institution": part(1), "end_year": part(2)}))).otherwise(F.array().cast(CANDIDATE["education"].dataType)),
        "skills": F.transform(names, lambda n: members(of("skills"), {"name": n, "duration_given": F.lit(False)})),
        "signals": members(CANDIDATE["signals"].dataType, {"notice_period_days": text.notice_days(t)}),
    }
    others = [c for c in resumes.columns if c not in CANDIDATE.fieldNames()]
    return rows.select(*others, *(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CANDIDATE.fields))


def dated_entries(entries: Column, ref: Column) -> Column:
    """Positions with dates: each older one ends where the newer starts, counted back from `ref`."""

    def step(back: Column, e: Column) -> tuple[Column, Column]:
        start = F.add_months(ref, -(back + e["months"]))
        end = F.when(~e["is_current"], F.add_months(ref, -back))
        row = F.struct(e["title"].alias("title"), e["company"].alias("company"), e["months"].alias("months"), start.alias("start_date"), end.alias("end_date"), e["description"].alias("description"))
        return back + e["months"], F.array(row)

    return arrays.gathered(entries, F.lit(0), "struct<title:string,company:string,months:int,start_date:date,end_date:date,description:string>", step)
