"""Secret rules: the starter set, loading from TOML text, and severity by rule id."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class SecretRule:
    """One rule. With ``prefilter`` a file without any of the ``keywords`` is not searched, so that the regex must imply
    one of them; without it the keywords are only kept.

    Keywords are compared case-insensitively unless ``exact_keywords`` is set.
    """

    rule_id: str
    description: str
    regex: str
    entropy: float | None = None
    keywords: tuple[str, ...] = ()
    exact_keywords: bool = False
    prefilter: bool = False

    @property
    def severity(self) -> str:
        if any(marker in self.rule_id for marker in CRITICAL_MARKERS):
            return "critical"
        return "medium" if any(marker in self.rule_id for marker in MEDIUM_MARKERS) else "high"


# Rule-id markers. Critical ones are tested first; all other rules are high.
CRITICAL_MARKERS = [
    "private-key", "aws-access-token", "gcp-service-account", "azure-storage", "github-pat",
    "github-fine-grained-pat", "github-oauth", "github-app-token", "stripe-access-token",
    "vault-service-token", "vault-batch-token",
]
MEDIUM_MARKERS = [
    "adafruit", "airtable", "beamer", "contentful", "doppler", "dropbox", "duffel", "fastly", "freshbooks",
    "gocardless", "linkedin", "lob", "microsoft-teams-webhook", "new-relic", "pypi-upload-token", "readme",
    "sendgrid", "sentry", "shopify-shared-secret", "trello", "twitter",
]


def rule_severity(rule_id: Column) -> Column:
    """Severity of a rule id column."""

    def has_any(markers: list[str]) -> Column:
        return F.rlike(rule_id, F.lit("|".join(re.escape(m) for m in markers)))

    return (
        F.when(has_any(CRITICAL_MARKERS), F.lit("critical"))
        .when(has_any(MEDIUM_MARKERS), F.lit("medium"))
        .otherwise(F.lit("high"))
    )


def _rule(rule_id, description, entropy, regex, *keywords, exact=True):
    return SecretRule(rule_id, description, regex, entropy, tuple(keywords), exact, prefilter=True)


# Publicly documented token formats.
STARTER_RULES: list[SecretRule] = [
    _rule("private-key", "Private key block", None,
          r"-----BEGIN[ A-Z0-9_-]{0,100}PRIVATE KEY(?: BLOCK)?-----(?s:.*?)-----END[ A-Z0-9_-]{0,100}KEY(?: BLOCK)?-----",
          "-----BEGIN"),
    _rule("aws-access-token", "AWS access key id", 3.0, r"\b(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}\b",
          "AKIA", "ASIA", "ABIA", "ACCA"),
    _rule("gcp-service-account", "Google service account file", None, r'"type"\s*:\s*"service_account"',
          "service_account"),
    _rule("azure-storage", "Azure storage account key", None, r"AccountKey=[A-Za-z0-9+/]{86}==", "AccountKey="),
    _rule("github-pat", "GitHub personal access token", 3.0, r"ghp_[0-9A-Za-z]{36}", "ghp_"),
    _rule("github-fine-grained-pat", "GitHub fine-grained token", 3.0, r"github_pat_[0-9A-Za-z_]{82}", "github_pat_"),
    _rule("github-oauth", "GitHub OAuth token", 3.0, r"gho_[0-9A-Za-z]{36}", "gho_"),
    _rule("github-app-token", "GitHub app token", 3.0, r"(?:ghu|ghs)_[0-9A-Za-z]{36}", "ghu_", "ghs_"),
    _rule("stripe-access-token", "Stripe access token", 2.0, r"\b[sr]k_(?:test|live|prod)_[0-9A-Za-z]{10,99}\b",
          "k_test_", "k_live_", "k_prod_"),
    _rule("vault-service-token", "Vault service token", 3.5, r"\bhvs\.[A-Za-z0-9_-]{90,120}", "hvs."),
    _rule("vault-batch-token", "Vault batch token", 3.5, r"\bhvb\.[A-Za-z0-9_-]{138,300}", "hvb."),
    _rule("sendgrid", "SendGrid API key", 2.0, r"\bSG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", "SG."),
    _rule("pypi-upload-token", "PyPI upload token", 3.0, r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,400}",
          "pypi-AgEIcHlwaS5vcmc"),
    _rule("shopify-shared-secret", "Shopify shared secret", 2.0, r"shpss_[a-fA-F0-9]{32}", "shpss_"),
    _rule("new-relic", "New Relic user key", None, r"\bNRAK-[A-Z0-9]{27}\b", "NRAK-"),
    _rule("doppler", "Doppler token", 2.0, r"dp\.pt\.[A-Za-z0-9]{43}", "dp.pt."),
    _rule("readme", "ReadMe key", 2.0, r"rdme_[a-z0-9]{70}", "rdme_"),
    _rule("duffel", "Duffel token", 2.0, r"duffel_(?:test|live)_[A-Za-z0-9_=-]{43}", "duffel_"),
    _rule("slack-bot-token", "Slack bot token", 3.0, r"xoxb-[0-9]{10,13}-[0-9]{10,13}[A-Za-z0-9-]*", "xoxb-"),
    _rule("gitlab-pat", "GitLab personal access token", 3.0, r"glpat-[A-Za-z0-9_-]{20}", "glpat-"),
    _rule("npm-access-token", "npm access token", 3.0, r"npm_[A-Za-z0-9]{36}", "npm_"),
    _rule("gcp-api-key", "Google API key", 3.0, r"AIza[A-Za-z0-9_-]{35}", "AIza"),
    _rule("jwt", "JSON web token", 3.0, r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "eyJ"),
    _rule("generic-api-key", "Generic API key", 3.5,
          r"(?i:key|token|secret|password|passwd|auth)[A-Za-z0-9_.-]{0,20}\s{0,5}[:=]\s{0,5}"
          r"[\"'][A-Za-z0-9_.=+/-]{10,150}[\"']",
          "key", "token", "secret", "password", "passwd", "auth", exact=False),
]


def java_regex(regex: str, unicode: bool = True) -> str:
    """A rule regex in the dialect of the JVM.

    ``.`` stops at LF only and, with ``unicode``, word and space classes cover Unicode. Named groups and
    POSIX classes are respelled, and an end anchor outside multi-line mode means the very end.
    """
    out = regex.replace("(?P<", "(?<")
    out = re.sub(r"\[:(\w+):\]", lambda m: r"\p{%s}" % m.group(1).capitalize(), out)
    if not re.search(r"\(\?[a-zA-Z]*m", out):
        out = re.sub(r"(?<!\\)((?:\\\\)*)\$(?=$|\)|\|)", r"\1\\z", out)
    return ("(?dU)" if unicode else "(?d)") + out


def load_rules(spark: SparkSession, toml_text: str) -> tuple[list[SecretRule], list[tuple[str, str]]]:
    """Rules of a TOML document with ``[[rules]]`` entries, and ``(id, reason)`` of the skipped ones.

    Entries without a regex and entries whose regex does not compile are skipped. Text that is not valid TOML, or in
    which an entry has no id, gives no rules. Keywords do not restrict the search. The rule list is a parameter table: it stays on the driver and becomes literals.
    """
    try:
        entries = tomllib.loads(toml_text).get("rules", [])
    except tomllib.TOMLDecodeError as error:
        return [], [("*", f"unreadable rule file: {error}")]
    if not all(isinstance(entry, dict) and isinstance(entry.get("id"), str) for entry in entries):
        return [], [("*", "unreadable rule file: an entry without id")]
    rules, skipped = [], []
    compiler = spark._jvm.java.util.regex.Pattern
    for entry in entries:
        rule_id, regex = entry["id"], entry.get("regex")
        if not regex:
            skipped.append((rule_id, "path-only"))
            continue
        try:
            compiler.compile(java_regex(regex))
        except Exception as error:  # the compiler's message names the place
            skipped.append((rule_id, str(getattr(error, "java_exception", error)).splitlines()[0]))
            continue
        entropy = entry.get("entropy")
        rules.append(
            SecretRule(
                rule_id, entry.get("description", ""), regex, None if entropy is None else float(entropy),
                tuple(entry.get("keywords", ())),
            )
        )
    return rules, skipped


def rules_frame(spark: SparkSession, rules: Iterable[SecretRule]) -> DataFrame:
    """The rules as a table."""
    return spark.createDataFrame(
        [(r.rule_id, r.description, r.regex, r.entropy, list(r.keywords)) for r in rules],
        "rule_id string, description string, regex string, entropy double, keywords array<string>",
    )


def skipped_frame(spark: SparkSession, skipped: Iterable[tuple[str, str]]) -> DataFrame:
    """The skipped rules as a table."""
    return spark.createDataFrame(list(skipped), "rule_id string, reason string")
