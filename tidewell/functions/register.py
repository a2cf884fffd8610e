"""The scalar functions by name, for SQL of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewell.functions import analyzers, text, url
from tidewell.runtime import ship

#: name -> (parameters, type, expression in SQL).
EXPRESSIONS = {
    "url_domain": ("url STRING", "STRING", r"lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"),
    "text_tokens": ("text STRING", "ARRAY<STRING>", "regexp_extract_all(lower(coalesce(text, '')), '" + text.TOKEN.replace("'", "\\'") + "', 0)"),
    "word_stem": ("word STRING", "STRING", f"regexp_replace(word, '{text.STEM}', '$1')"),
    "length_score": ("words BIGINT", "DOUBLE", "if(words <= 0, 0D, round(1 / (1 + exp(-0.008D * (words - 300))), 4))"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers the functions and names them; expressions stay in the JVM."""
    ship(spark)
    for name, (parameters, kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("normalize_url", url.normalize_one)
    spark.udf.register("porter_stem", analyzers.porter_stem)
    return [*EXPRESSIONS, "normalize_url", "porter_stem"]


