"""The library's kernels under names in SQL: scalar functions over columns, and tokens as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bibweave.functions import fuzzy, names, text

#: SQL name and function.
SCALARS = {
    "bib_indel_ratio": fuzzy.indel_ratio, "bib_token_set_ratio": fuzzy.token_set_ratio, "bib_normalize_name": names.normalize_name, "bib_author_agreement": names.author_agreement,
    "bib_nfkd": names.nfkd, "bib_nfkc": text.nfkc,
}


@F.udtf(returnType="tok int, token string, start int, `end` int", useArrow=True)
class BibTokens:
    """Words and single punctuation marks of a text, with their place and offsets; none for null."""

    def eval(self, value: str):
        from bibweave.operators.labels import TOKEN

        for tok, m in enumerate(TOKEN.finditer(value or "")):
            yield tok, m.group(), m.start(), m.end()


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL, returns their names. ``bib_tokens`` follows LATERAL in a FROM clause."""
    for name, function in SCALARS.items():
        spark.udf.register(name, function)
    spark.udtf.register("bib_tokens", BibTokens)
    return [*SCALARS, "bib_tokens"]
