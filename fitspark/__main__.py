"""python -m fitspark: check or compare role profiles, compile texts, score candidates, rank a study, or make résumés."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="fitspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    check = sub.add_parser("check", help="check a role profile in YAML")
    check.add_argument("profile")
    fit = sub.add_parser("fit", help="score candidates in JSON lines against a role profile")
    for name in ("candidates", "profile", "out"):
        fit.add_argument(name)
    fit.add_argument("--ref-date")
    study = sub.add_parser("study", help="summarise study scores in CSV")
    study.add_argument("scores")
    resumes = sub.add_parser("resumes", help="make résumés for jobs in JSON lines (jd_slug, title, skills)")
    resumes.add_argument("jobs")
    resumes.add_argument("out")
    parity = sub.add_parser("parity", help="compare two role profiles in YAML")
    parity.add_argument("one")
    parity.add_argument("other")
    for kind, what in (("roles", "job"), ("candidates", "résumé")):
        compiling = sub.add_parser(f"compile-{kind}", help=f"compile {what} texts, one a file, by a model")
        compiling.add_argument("texts", help="a folder")
        compiling.add_argument("out")
        compiling.add_argument("--model", default="fitspark.backends:MockBackend", help="module:callable that makes a text backend")
        compiling.add_argument("--ref-date")
    a = p.parse_args(argv)

    from fitspark.config import ProfileError, load_role, structural

    if a.command == "check":
        try:
            with open(a.profile, encoding="utf-8") as f:
                print(json.dumps(structural(load_role(f.read()))))
        except ProfileError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    if a.command == "parity":
        from fitspark.config import parity as compared

        profiles = []
        for path in (a.one, a.other):
            with open(path, encoding="utf-8") as f:
                profiles.append(structural(load_role(f.read())))
        print(json.dumps(compared(*profiles)))
        return 0
    spark = SparkSession.builder.appName("fitspark").getOrCreate()
    if a.command == "fit":
        from fitspark.embedding import HashEmbedding
        from fitspark.operators.intrinsic import candidates_of
        from fitspark.plans.session import fit_candidates

        with open(a.profile, encoding="utf-8") as f:
            role = load_role(f.read())
        rows = candidates_of(spark.read.text(a.candidates).withColumnRenamed("value", "candidate_json"))
        fit_candidates(rows, role, HashEmbedding(), ref_date=a.ref_date).write.mode("overwrite").json(a.out)
    elif a.command == "study":
        from fitspark.plans.session import report
        from fitspark.sources.study import read_scores

        print(report(read_scores(spark, a.scores)))
    elif a.command.startswith("compile-"):
        from fitspark.plans.compile import compile_candidates, compile_roles
        from fitspark.plans.workflows import write_table

        module, _, name = a.model.partition(":")
        model = getattr(importlib.import_module(module), name)()
        key = "jd_slug" if a.command == "compile-roles" else "resume_id"
        files = spark.read.text(a.texts, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias(key), F.col("value").alias("text"))
        made = compile_roles(files, model, write_table) if key == "jd_slug" else compile_candidates(files, model, write_table, ref_date=a.ref_date)
        made.write.mode("overwrite").json(a.out)
    else:
        from fitspark.sources.study import make_resumes

        make_resumes(spark.read.schema("jd_slug string, title string, skills array<string>").json(a.jobs)).write.mode("overwrite").partitionBy("jd_slug", "tier").json(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
