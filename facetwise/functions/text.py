"""Question texts: tokens, intent, flags and similarity, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = "([a-z0-9']+)"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def normalised(text: Column) -> Column:
    """Tokens joined by single blanks; empty for null."""
    return F.coalesce(F.array_join(tokens(text), " "), F.lit(""))


# The words and phrases that decide a question's intent.
SMALLTALK_WORDS = ("hi", "hello", "hey", "thanks", "thx")
SMALLTALK_PHRASES = ("thank you", "who are you", "what are you", "what can you do")
ANOMALY_STARTS = ("anomal", "outlier")
ANOMALY_WORDS = ("unusual", "weird", "strange")
CLUSTER_STARTS = ("cluster", "group", "segment")
CLUSTER_WORDS = ("similar",)
FORECAST_STARTS = ("forecast", "predict")
FORECAST_WORDS = ("future", "trend")
FORECAST_PHRASES = ("next month",)
CORRELATION_STARTS = ("correl",)
CORRELATION_WORDS = ("relationship", "relationships")
CORRELATION_LINKS = ("related", "associated", "linked")
COLUMN_WORDS = ("column", "columns")
CORRELATION_PHRASES = ("two columns", "most related", "most correlated")
SUMMARY_WORDS = ("summarize", "summary")
DATA_WORDS = ("dataset", "data")
DESCRIPTIVE_PHRASES = (
    "describe", "overview", "tell me about", "about the data", "about this data", "what columns", "which columns",
    "list columns", "show columns", "schema", "data dictionary", "data types", "dtypes", "missing values",
    "null values", "nulls", "duplicates", "duplicate rows", "how many rows", "how many columns",
)
DESCRIPTIVE_WORDS = ("columns", "dtype")
# Substrings that ask for a chart, and phrases that ask for importance.
CHART_MARKS = (
    "chart", "charts", "graph", "graphs", "plot", "plots", "hist", "histogram", "distribution", "dist", "density",
    "boxplot", "box plot", "violin", "bar", "line", "scatter", "pie", "heatmap", "correlation", "corr", "matrix",
    "visualize", "visualise", "visualization", "visualisation",
)
IMPORTANCE_MARKS = (
    "most important feature", "important feature", "feature importance", "most important column", "key feature",
    "key driver", "most influential",
)


def _word(text: Column, words) -> Column:
    return text.rlike("(^| )(" + "|".join(words) + ")( |$)")


def _start(text: Column, starts) -> Column:
    return text.rlike("(^| )(" + "|".join(starts) + ")")


def _anywhere(text: Column, marks) -> Column:
    return text.rlike("|".join(marks))


def intent(question: Column) -> Column:
    """One of smalltalk, anomaly, clustering, forecast, correlation, descriptive, analytical.

    The first rule that holds decides. Words are whole tokens, starts are token
    prefixes, phrases may lie anywhere in the normalised text.
    """
    q = normalised(question)
    about_columns = _word(q, CORRELATION_LINKS) & _word(q, COLUMN_WORDS)
    overview = _word(q, SUMMARY_WORDS) & _word(q, DATA_WORDS) & ~_word(q, ("by",))
    rules = (
        ("smalltalk", _word(q, SMALLTALK_WORDS) | _anywhere(q, SMALLTALK_PHRASES)),
        ("anomaly", _start(q, ANOMALY_STARTS) | _word(q, ANOMALY_WORDS)),
        ("clustering", _start(q, CLUSTER_STARTS) | _word(q, CLUSTER_WORDS)),
        ("forecast", _start(q, FORECAST_STARTS) | _word(q, FORECAST_WORDS) | _anywhere(q, FORECAST_PHRASES)),
        (
            "correlation",
            _start(q, CORRELATION_STARTS)
            | _word(q, CORRELATION_WORDS)
            | about_columns
            | _anywhere(q, CORRELATION_PHRASES),
        ),
        ("descriptive", overview | _anywhere(q, DESCRIPTIVE_PHRASES) | _word(q, DESCRIPTIVE_WORDS)),
    )
    result = F.lit("analytical")
    for name, holds in reversed(rules):
        result = F.when(holds, name).otherwise(result)
    return result


def wants_chart(question: Column) -> Column:
    """True where any chart word occurs, even inside another word."""
    return _anywhere(F.lower(F.coalesce(question, F.lit(""))), CHART_MARKS)


def wants_importance(question: Column) -> Column:
    return _anywhere(F.lower(F.coalesce(question, F.lit(""))), IMPORTANCE_MARKS)


def plain(text: Column) -> Column:
    """Trimmed lower case, ``_`` and ``-`` as blanks, other marks dropped, single blanks."""
    cleaned = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[_\\-]+", " ")
    cleaned = F.regexp_replace(cleaned, "[^a-z0-9\\s]", "")
    return F.regexp_replace(cleaned, "\\s+", " ")


ACCEPTED_OVERLAP = 0.78
CONTAINED_SCORE = 0.92


def words_of(plain_text: Column) -> Column:
    return F.filter(F.split(plain_text, " "), lambda w: w != "")


def token_overlap(a: Column, b: Column) -> Column:
    """1 for equal texts, 0.92 when one contains the other, else the share of words in
    common (repeats in ``b`` count) of the longer text."""
    x, y = plain(a), plain(b)
    return overlap_score(x, words_of(x), y, words_of(y))


def overlap_score(x: Column, xs: Column, y: Column, ys: Column) -> Column:
    """``token_overlap`` of texts already made ``plain``, with their words."""
    common = F.size(F.filter(ys, lambda w: F.array_contains(xs, w)))
    longer = F.greatest(F.size(xs), F.size(ys))
    return (
        F.when((x == "") | (y == ""), 0.0)
        .when(x == y, 1.0)
        .when(F.contains(x, y) | F.contains(y, x), CONTAINED_SCORE)
        .when((F.size(xs) == 0) | (F.size(ys) == 0), 0.0)
        .otherwise(common / longer)
    )
