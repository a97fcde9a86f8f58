"""Times the headline queries and prints one JSON line.

The files table is written once before timing starts, as a corpus would be. Results go to Spark's noop sink,
so every row is computed and none is collected. Each query runs twice; the better run counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from sparkwarden.operators import lockfiles, provenance, secrets, vulnerabilities
from sparkwarden.operators.findings import counts_by_severity, for_languages
from sparkwarden.plans.audit import Tables, audit
from sparkwarden.plans.registry import Inputs
from sparkwarden.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def main() -> None:
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    t = Inputs(spark, SF_DIR)
    files = t.files
    code = for_languages(files, secrets.LANGUAGES)
    # Each repository since its last commit but one: few files changed.
    last = t.commits.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("author_ts", "sha")), asc=False).alias("c"))
    refs = last.select("repo", F.get("c", F.lit(1))["sha"].alias("ref"))
    lines = files.selectExpr("sum(length(content) - length(replace(content, chr(10), '')))").collect()[0][0]
    queries = {
        "secrets_code": lambda: secrets.secret_findings(code),
        "secrets_documents": lambda: counts_by_severity(secrets.secret_findings(t.text_files.unionByName(t.page_files))),
        "text_signals": lambda: provenance.text_signals(files),
        "provenance": lambda: provenance.provenance(files, t.commits, t.commit_files),
        "lockfile_packages": lambda: lockfiles.chosen_packages(files),
        "advisory_join": lambda: vulnerabilities.advisory_findings(lockfiles.chosen_packages(files), t.advisories),
        "exact_join": lambda: vulnerabilities.exact_findings(lockfiles.chosen_packages(files), t.osv_vulns),
        "audit": lambda: audit(Tables(files, t.commits, t.commit_files, t.advisories, t.osv_vulns)),
        "audit_diff": lambda: audit(Tables(files, t.commits, t.commit_files, t.advisories, t.osv_vulns, refs=refs)),
    }
    best: dict[str, float] = {}
    for _ in range(2):
        for name, build in queries.items():
            start = time.time()
            build().write.format("noop").mode("overwrite").save()
            best[name] = min(best.get(name, float("inf")), time.time() - start)
    total = sum(best.values())
    print(
        json.dumps(
            {
                "metric": "audit_queries_total",
                "value": round(total, 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in best.items()},
                "sf": os.path.basename(SF_DIR).removeprefix("sf"),
                "lines_of_code": int(lines),
                "audit_lines_per_sec": round(lines / best["audit"]),
                "secrets_lines_per_sec": round(lines / best["secrets_code"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
