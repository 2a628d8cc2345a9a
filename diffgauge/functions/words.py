"""Stop words and language keywords that never count as attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names of the numeric features in the attribution table.
NUMERIC_FEATURES = ("*deletedLine", "*addedLine", "*changedLine")

# English stop words.
ENGLISH = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now").split()

# Python built-ins and keywords.
PYTHON = (
    "abs delattr hash memoryview set all dict help min setattr any dir hex next slice ascii divmod "
    "id object sorted bin enumerate input oct staticmethod bool eval int open str breakpoint exec "
    "isinstance ord sum bytearray filter issubclass pow super bytes float iter print tuple callable "
    "format len property type chr frozenset list range vars classmethod getattr locals repr zip "
    "compile globals map reversed import complex hasattr max round False await else import passNone "
    "break except in raise True class finally is return and continue for lambda try as def from "
    "nonlocal while assert del global not with async elif if or yield self").split()

# C and C++ keywords.
C_FAMILY = (
    "auto const double float int short struct unsigned break continue else for long signed switch "
    "void case default enum goto register sizeof typedef volatile char do extern if return static "
    "union while asm namespace try bool explicit new typeid catch false operator template typename "
    "class friend private this using inline public throw virtual delete mutable protected true").split()

KEYWORDS = {"python": PYTHON, "c": C_FAMILY}


def stop_words(spark: SparkSession, languages=None) -> DataFrame:
    """(language, token): English words, numeric features and keywords per language.

    ``languages`` maps a language key to a keyword list; default Python and C.
    """
    rows = [(lang, w) for lang, keywords in (languages or KEYWORDS).items()
            for w in dict.fromkeys([*NUMERIC_FEATURES, *ENGLISH, *keywords])]
    return spark.createDataFrame(rows, "language string, token string")
