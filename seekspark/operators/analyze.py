"""Query analysis as column expressions: features, type, complexity, confidence, recommended strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import analyzer_tokens, contains_any, count_in, has_any, query_terms, script_class, space_tokens

# The word lists that the classification is defined on.
TECHNICAL_WORDS = ["api", "http", "json", "sql", "ai", "ml", "cnn", "rnn", "lstm", "gpu", "cpu", "알고리즘", "데이터베이스", "프레임워크", "라이브러리", "인터페이스", "transformer"]
TECHNICAL_PHRASES = ["machine learning", "deep learning", "neural network"]
QUESTION_WORDS = ["what", "who", "when", "where", "why", "how", "which", "whose", "무엇", "누구", "언제", "어디", "왜", "어떻게", "무슨", "어느"]
COMPARISON_WORDS = ["compare", "versus", "vs", "difference", "similar", "different", "better", "worse", "비교", "차이", "유사", "다른", "더", "덜", "보다"]
TEMPORAL_WORDS = ["when", "before", "after", "during", "recent", "latest", "future", "past", "언제", "전", "후", "동안", "최근", "최신", "미래", "과거"]
LOGICAL_WORDS = ["and", "or", "not", "but", "however", "therefore", "because", "그리고", "또는", "하지만", "그러나", "따라서", "때문에"]
DETAIL_WORDS = ["detailed", "explanation", "analyze", "comprehensive", "thorough"]
REASONING_PHRASES = ["why", "how does", "how do", "explain", "reason", "because", "cause", "effective", "왜", "어떻게", "설명", "이유", "때문"]
REASONING_WORDS = ["why", "how", "explain", "reason", "effective", "because"]
MULTI_HOP_PHRASES = ["and then", "after that", "다음에", "그리고", "또한"]
STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "을", "를", "이", "가", "은", "는"]
SMALL_TECHNICAL = ["API", "HTTP", "JSON", "SQL", "AI", "ML", "CNN", "RNN", "LSTM", "알고리즘", "데이터베이스", "프레임워크", "라이브러리", "인터페이스"]
SMALL_QUESTIONS = ["what", "who", "when", "where", "why", "how", "무엇", "누구", "언제", "어디", "왜", "어떻게"]
SMALL_LOGICAL = ["and", "or", "not", "그리고", "또는", "아니", "AND", "OR", "NOT"]
EXPANSIONS = [("machine learning", "ML"), ("machine learning", "artificial intelligence"), ("neural network", "deep learning"), ("neural network", "artificial neural network")]
CATEGORIES = {"기술": ["기술", "프로그래밍", "개발", "시스템", "알고리즘"], "비즈니스": ["비즈니스", "마케팅", "경영", "전략", "수익"], "과학": ["과학", "연구", "실험", "데이터", "분석"], "일반": ["일반", "정보", "설명", "개념", "정의"]}
GENERAL_CUTS = [" 구체적인 ", " 특정 ", " 정확한 "]
SYNONYMS = {"computer": "컴퓨터", "software": "소프트웨어", "technology": "기술"}
OUTCOMES = {"Conservative": (0.02, 0.3, 0.7), "Balanced": (0.05, 0.6, 0.8), "Aggressive": (0.08, 0.9, 0.85), "Adaptive": (0.06, 0.7, 0.9)}


def any_of(c: Column, phrases: list[str]) -> Column:
    return contains_any(c, phrases)


def points(*ladder: tuple[Column, int]) -> Column:
    """The value of the first condition that holds, else 0."""
    out = None
    for cond, value in ladder:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(0)


def analysis(queries: DataFrame, text: str = "text") -> DataFrame:
    """Adds the analyzer's columns to `queries`."""
    q, t = F.col(text), F.col("tokens")
    df = queries.withColumn("tokens", analyzer_tokens(q))
    df = df.withColumns({
        "n_tokens": F.size(t), "n_question": count_in(t, QUESTION_WORDS), "n_technical": count_in(t, TECHNICAL_WORDS), "n_logical": count_in(t, LOGICAL_WORDS),
        "comparative": has_any(t, COMPARISON_WORDS), "temporal": has_any(t, TEMPORAL_WORDS), "reasoning": any_of(q, REASONING_PHRASES) | has_any(t, REASONING_WORDS),
        "language": script_class(q), "keywords": F.filter(t, lambda x: ~x.isin(STOP_WORDS) & (F.length(x) > 2)), "concepts": F.filter(t, lambda x: x.isin(TECHNICAL_WORDS) | (F.length(x) > 6)),
    })
    df = df.withColumn("multi_hop", any_of(q, MULTI_HOP_PHRASES) | (F.col("n_logical") > 1))
    asks = F.col("n_question") > 0
    kind = (
        F.when(asks & F.col("multi_hop"), "MultiHopQuery").when(asks & F.col("comparative"), "ComparisonQuery").when(asks & F.col("temporal"), "TemporalQuery").when(asks & F.col("reasoning"), "ReasoningQuery")
        .when(asks, "NaturalQuestion").when((F.col("n_logical") > 0) | q.contains("AND") | q.contains("OR"), "ComplexSearch").when(F.col("comparative"), "ComparisonQuery").when(F.col("reasoning"), "ReasoningQuery").otherwise("SimpleKeyword")
    )
    technical = F.col("n_technical") + sum((F.contains(F.lower(q), F.lit(p)).cast("int") for p in TECHNICAL_PHRASES), F.lit(0))
    score = (
        points((F.col("n_tokens") > 10, 2), (F.col("n_tokens") > 5, 1)) + points((F.col("n_question") > 1, 2), (asks, 1)) + points((technical > 2, 3), (technical > 1, 2), (technical > 0, 1))
        + points((has_any(t, DETAIL_WORDS), 2)) + points((F.col("n_logical") > 0, 1)) + points((F.col("comparative"), 1)) + points((F.col("temporal"), 1)) + points((F.col("multi_hop"), 2)) + points((F.col("reasoning"), 2))
    )
    n = F.col("n_tokens")
    specificity = F.when(n > 0, F.least(F.lit(1.0), (F.size(F.array_distinct(t)) / n + F.col("n_technical") / n) / 2)).otherwise(0.0)
    confidence = 0.5 + F.when((n >= 2) & (n <= 15), 0.2).otherwise(0.0) + F.when(asks, 0.1).otherwise(0.0) + F.when(F.col("n_technical") > 0, 0.1).otherwise(0.0) - F.when(n < 2, 0.2).otherwise(0.0) - F.when(n > 20, 0.1).otherwise(0.0)
    millis = F.least(F.lit(10000), 500 + 10 * n + 1000 * F.col("reasoning").cast("int") + 1500 * F.col("multi_hop").cast("int") + 500 * F.col("comparative").cast("int"))
    intent = F.when(asks, "Informational").when(F.col("comparative") | F.exists(t, lambda x: x.contains("analyz")), "Analytical").when(F.exists(t, lambda x: x.contains("find") | x.contains("search")), "Exploratory").otherwise("Informational")
    df = df.withColumns({"type": kind, "points": score, "specificity": specificity, "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.1), confidence)), "estimated_ms": millis, "intent": intent})
    p = F.col("points")
    df = df.withColumn("complexity", F.when(p <= 1, "Simple").when(p <= 3, "Moderate").when(p <= 5, "Complex").otherwise("VeryComplex"))
    return df.withColumn("recommended", recommended())


def recommended() -> Column:
    c, r, m = F.col("complexity"), F.col("reasoning"), F.col("multi_hop")
    return (
        F.when(c == "Simple", "DirectVector").when(c == "Moderate", F.when(F.col("comparative"), "MultiQuery").otherwise("Hybrid")).when(c == "Complex", F.when(r, "TwoStage").when(m, "MultiQuery").otherwise("Hybrid"))
        .otherwise(F.when(m & r, "SelfRAG").when(r, "TwoStage").otherwise("Adaptive"))
    )


def strategy() -> Column:
    """The strategy a search takes: by type where the analysis is confident, else the recommended one."""
    k = F.col("type")
    by_type = F.when(k.isin("SimpleKeyword", "NaturalQuestion"), "DirectVector").when(k == "ComplexSearch", "Hybrid").when(k == "ReasoningQuery", "Adaptive").when(k == "ComparisonQuery", "MultiQuery").when(k == "TemporalQuery", "TwoStage").when(k == "MultiHopQuery", "SelfRAG")
    return F.when(F.round("confidence", 9) >= 0.8, F.coalesce(by_type, F.col("recommended"))).otherwise(F.col("recommended"))


def alternative(c: Column) -> Column:
    """The strategy tried when one did not do."""
    return F.when(c == "DirectVector", "Hybrid").when(c == "Hybrid", "TwoStage").when(c == "TwoStage", "MultiQuery").when(c == "MultiQuery", "HyDE").when(c == "HyDE", "StepBack").otherwise("Hybrid")


def other_arm(c: Column) -> Column:
    """The strategy that an A/B test sets against one."""
    return F.when(c == "KeywordOnly", "DirectVector").when(c == "Hybrid", "TwoStage").when(c == "TwoStage", "MultiQuery").otherwise("Hybrid")


def syntax(c: Column) -> Column:
    """Phrase, Boolean, Keyword or Natural, by how a query is written."""
    return F.when(F.contains(c, F.lit('"')), "Phrase").when(F.contains(c, F.lit(" AND ")) | F.contains(c, F.lit(" OR ")), "Boolean").when(F.size(F.split(c, " ")) <= 3, "Keyword").otherwise("Natural")


def syntax_complexity(c: Column) -> Column:
    """0 to 1: a tenth for each word, ten at most, and a tenth for each punctuation mark."""
    return F.least(F.lit(1.0), F.least(F.size(space_tokens(c)) / 10, F.lit(1.0)) + F.regexp_count(c, F.lit(r"\p{P}")) / 10)


def complexity_label(overall: Column) -> Column:
    # The names of the five steps.
    return F.when(overall <= 0.2, "매우 간단").when(overall <= 0.4, "간단").when(overall <= 0.6, "보통").when(overall <= 0.8, "복잡").otherwise("매우 복잡")


def context_strategy(overall: Column) -> Column:
    return F.when(overall <= 0.3, "Conservative").when(overall <= 0.7, "Balanced").otherwise("Aggressive")


def subqueries(c: Column) -> Column:
    """The parts of a question that asks several things, split at conjunctions and marks; one part is the query itself."""
    parts = F.filter(F.transform(F.split(c, r"(?i)\s+(?:and then|and|or|versus|vs|그리고|또는)\s+|[?;]\s*"), lambda x: F.trim(x)), lambda x: F.length(x) > 2)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def hypothetical(c: Column) -> Column:
    """A passage such as an answer would begin with, for embedding where no model writes one: the query's keywords as a statement."""
    t = F.filter(analyzer_tokens(c), lambda x: ~x.isin([*STOP_WORDS, *QUESTION_WORDS]) & (F.length(x) > 2))
    return F.concat(F.array_join(t, " "), F.lit(" is described as follows: "), F.array_join(t, ", "), F.lit("."))


def asked_of(c: Column) -> Column:
    """Questions that a text could answer: one for each of its first sentences that is long enough."""
    sentences = F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: F.size(space_tokens(x)) >= 4)
    return F.transform(F.slice(sentences, 1, 3), lambda x: F.concat(F.lit("What about "), F.regexp_replace(F.lower(x), r"[.!?]+$", ""), F.lit("?")))


def expansions(c: Column, most: int = 3) -> Column:
    """The query and its phrase substitutions, at most `most`."""
    made = [F.when(F.contains(c, F.lit(a)), F.replace(c, F.lit(a), F.lit(b))) for a, b in EXPANSIONS]
    return F.slice(F.array_compact(F.array(c, *made)), 1, most)


def components(queries: DataFrame, text: str = "text") -> DataFrame:
    """Adds the four complexity axes, their weighted sum, the window size, and the expansion that is recommended."""
    w, least = F.col("words"), lambda x: F.least(F.lit(1.0), x)
    df = queries.withColumn("words", space_tokens(F.col(text)))
    upper = lambda x: x.rlike(r"^\p{Lu}") & (F.length(x) > 1)
    df = df.withColumns({
        "n": F.size(w), "u": F.size(F.array_distinct(F.transform(w, F.lower))), "t": F.size(F.filter(w, lambda x: x.rlike("(?i)" + "|".join(SMALL_TECHNICAL)))), "e": F.size(F.filter(w, upper)),
        "q": F.size(F.filter(w, lambda x: F.lower(x).isin(SMALL_QUESTIONS))), "l": count_in(w, SMALL_LOGICAL), "chars": F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)), "p": F.regexp_count(F.col(text), F.lit(r"\p{P}")),
    })
    n = F.greatest(F.lit(1), F.col("n"))
    density = F.when(F.length(text) > 0, F.col("p") / F.length(text)).otherwise(0.0)
    df = df.withColumns({
        "lexical": (F.col("u") / n + least(F.col("chars") / n / 10) + least(3 * F.col("t") / n)) / 3,
        "syntactic": (least(10 * density) + least(F.col("n") / 20) + least(5 * F.col("l") / n)) / 3,
        "semantic": (least(2 * F.col("e") / n) + least(3 * F.col("t") / n) + F.col("u") / n) / 3,
        "reasoning": (least(5 * F.col("q") / n) + least(3 * F.col("l") / n) + least(F.col("n") / 15)) / 3,
    })
    df = df.withColumn("overall", 0.2 * F.col("lexical") + 0.3 * F.col("syntactic") + 0.3 * F.col("semantic") + 0.2 * F.col("reasoning"))
    o = F.round("overall", 9)
    size = F.when(o <= 0.2, 1).when(o <= 0.4, 2).when(o <= 0.6, 4).when(o <= 0.8, 6).otherwise(8) + points((F.col("t") > 0, 1)) + points((F.col("e") > 2, 1)) + points((F.col("q") > 0, 1)) + points((F.col("l") > 0, 2))
    kind = F.when(o <= 0.3, "Conservative").when(o <= 0.6, "Balanced").when(o <= 0.8, "Aggressive").otherwise("Adaptive")
    methods = F.array_compact(F.array(F.lit("Sequential"), F.when(F.round("semantic", 9) > 0.5, "Semantic"), F.when(F.col("e") > 0, "Entity"), F.when(F.round("reasoning", 9) > 0.6, "Hierarchical")))
    confidence = F.least(F.lit(1.0), 0.8 + F.when(F.col("n") >= 3, 0.1).otherwise(0.0) + F.when(F.col("u") >= 2, 0.1).otherwise(0.0))
    df = df.withColumns({"window": F.least(F.lit(10), F.greatest(F.lit(1), size)), "expansion": kind, "methods": methods, "confidence": confidence})
    of = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in OUTCOMES.items() for x in (k, v[i]))), F.col("expansion"))
    return df.withColumns({"precision_gain": of(0), "richness": of(1), "latency_increase": F.size("methods") * 0.1, "satisfaction": F.least(F.lit(1.0), of(2) + 0.1 * F.col("overall"))})


def difficulty(c: Column) -> Column:
    n, hard = F.size(space_tokens(c)), c.contains("분석") | c.contains("비교") | c.contains("설명")
    asks = c.contains("왜") | c.contains("어떻게") | c.contains("무엇")
    return F.when((n <= 3) & ~hard, "Easy").when((n <= 7) & ~hard & asks, "Medium").when((n > 7) | hard, "Hard").otherwise("Medium")


def categories(c: Column) -> Column:
    found = F.array_compact(F.array(*(F.when(any_of(c, words), F.lit(name)) for name, words in CATEGORIES.items())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("일반")))


def generalized(c: Column) -> Column:
    for cut in GENERAL_CUTS:
        c = F.replace(c, F.lit(cut), F.lit(" "))
    return F.trim(c)


def specified(c: Column) -> Column:
    return F.when(F.contains(F.lower(c), F.lit("최근")) | F.contains(F.lower(c), F.lit("recent")), c).otherwise(F.concat(F.lit("최근 "), c))


def with_context(c: Column) -> Column:
    return F.concat(c, F.lit(" 상세 정보 설명"))


def restructured(c: Column) -> Column:
    """The last word first, from three words on."""
    w = F.split(c, " ")
    return F.when(F.size(w) > 2, F.array_join(F.concat(F.slice(w, -1, 1), F.slice(w, 1, F.size(w) - 1)), " ")).otherwise(c)


def synonyms(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))
    return F.array_compact(F.transform(query_terms(c), lambda x: F.try_element_at(known, F.lower(x))))
