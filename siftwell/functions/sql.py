"""The scalar functions under SQL names, and links as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftwell.functions import html, policy, text, urls


@F.udtf(returnType="ord int, url string, normalized_url string, text string, in_main_content boolean")
class ExtractLinks:
    """``extract_links(html, base)``: the distinct links of a page."""

    def eval(self, content: str, base: str):
        if content is not None:
            for i, link in enumerate(html.extract(content, "text/html", base or "")["links"]):
                yield i, link["url"], link["normalized_url"], link["text"], link["in_main_content"]


def register(spark: SparkSession) -> None:
    """``normalize_url``, ``clean_inline``, ``clean_plain_text``, ``check_url``, ``is_blocked_address``, ``extract_links``."""
    spark.udf.register("normalize_url", urls.normalize_url_udf)
    for name, cleaner in (("clean_inline", text.INLINE), ("clean_plain_text", text.PLAIN)):
        spark.udf.register(name, F.pandas_udf(lambda values, c=cleaner: values.map(c.text, na_action="ignore"), StringType()))
    spark.udf.register("check_url", policy.check_url_udf)
    spark.udf.register("is_blocked_address", policy.is_blocked_udf)
    spark.udtf.register("extract_links", ExtractLinks)
