"""Target URL parsing and blank rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, py_strip

# Fixed values that must equal the reference's.
GITHUB_HOST = r"github\.com"
DEFAULT_PREFIX = "https://github.com/"


def normalize_target(c, prefix: str = DEFAULT_PREFIX):
    """The page's normalisation: strip blanks; a value not starting with
    ``http`` gets the host prefix; blank stays blank."""
    s = py_strip(c)
    return (F.when(F.length(s) == 0, F.lit(""))
            .when(s.startswith("http"), s)
            .otherwise(F.concat(F.lit(prefix), s)))


def parse_targets(df: DataFrame, url_col: str = "url", kind: str = "pr",
                  host: str = GITHUB_HOST, normalize: bool = False) -> DataFrame:
    """Adds owner, repo, pr_number and ``reject_reason`` (null when parsed).

    ``kind='pr'``: ``https://<host>/O/R/pull/N`` matched at the start (text
    after it is allowed).  ``kind='repo'``: ``https://<host>/O/R``, PR URLs
    accepted too, one trailing ``.git`` removed.  Blanks around the value are
    stripped first; ``http://`` does not match.  Regex per row, no shuffle.
    """
    s = normalize_target(F.col(url_col)) if normalize else py_strip(F.col(url_col))
    if kind == "pr":
        pat = rf"^https://{host}/([^/]+)/([^/]+)/pull/(\d+)"
        owner = F.regexp_extract(s, pat, 1)
        repo = F.regexp_extract(s, pat, 2)
        num = F.regexp_extract(s, pat, 3)
        ok = F.regexp_like(s, F.lit(pat))
        number = F.when(ok, num.try_cast("long"))       # too long a number: null
        reason = "not a pull request URL"
    elif kind == "repo":
        pat = rf"^https://{host}/([^/]+)/([^/]+)"
        owner = F.regexp_extract(s, pat, 1)
        raw = F.regexp_extract(s, pat, 2)
        # one trailing ".git" removed
        repo = F.regexp_replace(raw, r"\.git$", "")
        ok = F.regexp_like(s, F.lit(pat))
        number = F.lit(None).cast("long")
        reason = "not a repository URL"
    else:
        raise ValueError("kind must be 'pr' or 'repo'")
    out = (df.withColumn("owner", F.when(ok, owner))
           .withColumn("repo", F.when(ok, repo))
           .withColumn("pr_number", number)
           .withColumn("reject_reason", F.when(~ok | F.col(url_col).isNull(), F.lit(reason))))
    return out


def split_rejects(df: DataFrame, reason_col: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows) from a frame with a reason column."""
    return df.filter(F.col(reason_col).isNull()), df.filter(F.col(reason_col).isNotNull())


def reject_blank(df: DataFrame, col: str, reason: str = "blank") -> DataFrame:
    """Adds ``reject_reason`` = reason for rows blank after ``str.strip()``."""
    return df.withColumn("reject_reason", F.when(is_blank(col), F.lit(reason)))
