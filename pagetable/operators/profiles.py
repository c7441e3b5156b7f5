"""Profile records in one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_PLAIN = ("name", "about", "headline", "location", "company", "job_title")


def _shown(date: Column) -> Column:
    """A missing date is the text ``None``."""
    return F.coalesce(date.cast("string"), F.lit("None"))


def profiles(raw: DataFrame) -> DataFrame:
    """``url``, six plain fields, ``experiences`` and ``education``; absent lists become empty.

    ``raw`` has ``experiences array<struct<position, company_name, from_date, to_date>>`` and
    ``educations array<struct<institution, degree>>``.
    """
    jobs = F.transform(
        "experiences",
        lambda e: F.struct(
            e["position"].alias("title"),
            e["company_name"].alias("company"),
            F.concat(_shown(e["from_date"]), F.lit(" - "), _shown(e["to_date"])).alias("duration"),
        ),
    )
    schools = F.transform(
        "educations",
        lambda e: F.struct(e["institution"].alias("school"), e["degree"].alias("degree")),
    )
    none_jobs = F.array().cast("array<struct<title:string,company:string,duration:string>>")
    none_schools = F.array().cast("array<struct<school:string,degree:string>>")
    return raw.select(
        "url",
        *_PLAIN,
        F.coalesce(jobs, none_jobs).alias("experiences"),
        F.coalesce(schools, none_schools).alias("education"),
    )
