"""Table schemas shared by the sources, operators and sinks."""

from __future__ import annotations

FILES = "repo string, path string, ext string, language string, content string, n_bytes long"

COMMITS = "repo string, sha string, author string, author_ts timestamp, author_hour int, message string"

COMMIT_FILES = "repo string, sha string, path string, status string, additions int, deletions int, staged boolean"

PACKAGES = "repo string, lockfile_path string, ecosystem string, name string, version string"

ADVISORIES = (
    "advisory_id string, ecosystem string, package string, title string, cvss double, url string, "
    "patched array<string>, unaffected array<string>, fetched_at timestamp"
)

OSV_VULNS = "ecosystem string, name string, version string, vuln_id string, modified string, fetched_at timestamp"

LOCATION = "struct<path:string,start_line:int,start_col:int,end_line:int,end_col:int,snippet:string>"

FIX = "struct<description:string,replacement:string>"

FINDINGS = (
    f"repo string, verifier_id string, rule_id string, severity string, message string, location {LOCATION}, "
    f"fix {FIX}, provenance_score double, metadata map<string,string>"
)

# One finding inside a file row, before it is exploded.
FINDING_ITEM = (
    "struct<verifier_id:string,rule_id:string,severity:string,message:string,"
    "start_line:int,start_col:int,end_line:int,end_col:int,snippet:string,metadata:map<string,string>>"
)
