"""Word lists, patterns and weights that results depend on, and settings with defaults.

The lists below are fixed values: results are only right with exactly these.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Words that are neither keywords nor entities.
STOPWORDS = (
    "the a an of for on at to in with without by from up down off over under and or but so nor yet as than that this these those then now when "
    "where which who whom whose will would could should may might must shall"
).split()
#: Question words, added so that "What does X like?" has the subject X.
INTERROGATIVES = "what why how whats does did do is are was were".split()

# Attributes of a memory, in order, each with its boost and the words that point to it.
ATTRIBUTES = (
    ("likes", 0.18, "like likes love enjoy favorite prefer adore interested interest fan"),
    ("vehicle", 0.18, "car cars truck vehicle drive drives driving ride rides motorcycle bike"),
    ("city", 0.20, "city town state country live lives living location home resides"),
    ("family", 0.22, "wife husband mom mother dad father brother sister daughter son child children kids family parent"),
    ("career", 0.17, "job work career profession occupation employment company office boss"),
    ("education", 0.15, "school college university degree major study studying education class"),
    ("pet", 0.20, "dog dogs cat cats pet pets animal puppy kitten"),
    ("food", 0.14, "food eat eats meal restaurant pizza burger coffee tea"),
    ("programming", 0.16, "python java c cpp c++ javascript coding programming developer software algorithm"),
    ("project", 0.16, "project build building prototype design develop developing"),
    ("goal", 0.23, "goal objective plan future target dream mission"),
    ("emotion", 0.10, "happy sad angry excited worried frustrated depressed anxious feeling feel"),
)

# Sentence patterns of facts, in order; the first that matches wins.
FACTS = (
    ("likes", r"^(.*?)\s+likes\s+(.*?)[.!]?$"),
    ("vehicle", r"^(.*?)\s+drives\s+(.*?)[.!]?$"),
    ("city", r"^(.*?)\s+lives\s+(?:in|at)\s+(.*?)[.!]?$"),
    ("career", r"^(.*?)\s+works\s+(?:at|for)\s+(.*?)[.!]?$"),
    ("pet", r"^(.*?)\s+owns\s+(.*?)[.!]?$"),
    ("education", r"^(.*?)\s+studies\s+(.*?)[.!]?$"),
    ("goal", r"^(.*?)\s+wants\s+(.*?)[.!]?$"),
)

# Phrases that mark a memory as important.
IMPORTANCE_PHRASES = (
    "remember this",
    "important",
    "critical",
    "essential",
    "key point",
    "vital",
    "crucial",
    "don't forget",
    "noteworthy",
    "significant",
    "priority",
    "urgent",
    "must remember",
    "need to know",
)

# Cues of relations between two entities.
RELATION_CUES = (
    ("likes", "likes"),
    ("loves", "likes"),
    ("hates", "dislikes"),
    ("dislikes", "dislikes"),
    ("works at", "works_at"),
    ("works for", "works_for"),
    ("lives in", "lives_in"),
    ("born in", "born_in"),
    ("created", "created"),
    ("developed", "developed"),
    ("built", "built"),
    ("wrote", "wrote"),
    ("says", "said"),
)

# How memory types are detected in a query and what is run for them, in order of priority.
# type, least confidence, exclude penalty, needs an entity, its boost, needs an attribute, its boost, graph depth, sources, words, exclusions
ROUTES = (
    ("semantic", 0.5, 2.0, False, 0.2, False, 0.15, 0, "vector attribute graph", "what|is|definition|means|describe|explain|called", "when|where|how to|code|function|event|happened"),
    ("episodic", 0.6, 2.5, True, 0.3, False, 0.1, 1, "vector graph", "when|where|event|happened|occurred|during|after|before", "what is|define|how to|code|formula"),
    ("procedural", 0.6, 2.0, False, 0.1, True, 0.25, 0, "bm25 attribute vector", "how to|steps|guide|tutorial|instructions|process|method|way to", "what is|define|code|function"),
    ("code", 0.7, 3.0, False, 0.1, False, 0.1, 0, "bm25 vector", "code|function|class|method|api|library|import|def|return", "what is|define|how to|when"),
    ("science", 0.6, 2.0, True, 0.3, True, 0.3, 0, "vector attribute graph", "formula|equation|theory|hypothesis|experiment|data|measurement|scientific", "how to|code|when|event"),
    ("general", 0.0, 0.0, False, 0.2, False, 0.15, 1, "vector bm25 graph attribute", "", ""),
)
#: Points of one detected word.
KEYWORD_POINTS = 1.0
MEMORY_TYPES = ("semantic", "episodic", "procedural", "code", "science", "general")

# Weights of the signals by the type of the query; the default where a type has none.
SIGNALS = {
    "semantic": dict(default=0.21, semantic=0.30, episodic=0.10, procedural=0.15, code=0.10, science=0.20, general=0.20),
    "token": dict(default=0.3107, semantic=0.15, episodic=0.35, procedural=0.35, code=0.40, science=0.10, general=0.20),
    "entity": dict(default=0.0272, semantic=0.15, episodic=0.20, procedural=0.15, code=0.30, science=0.25, general=0.15),
    "subject": dict(default=0.098, semantic=0.20, episodic=0.05, procedural=0.05, code=0.05, science=0.15, general=0.15),
    "attribute": dict(default=0.011, semantic=0.15, episodic=0.02, procedural=0.10, code=0.05, science=0.25, general=0.10),
    "recency": dict(default=0.0268, semantic=0.02, episodic=0.35, procedural=0.10, code=0.01, science=0.05, general=0.05),
    "importance": dict(default=0.08),
    "feedback": dict(default=0.0268),
    "graph": dict(default=0.0),
    "tfidf": dict(default=0.2929, semantic=0.15, episodic=0.02, procedural=0.25, code=0.30, science=0.20, general=0.15),
}
# Days after which a memory's recency has fallen to 1/e, by its type; 30 for others.
RECENCY_DAYS = {"episodic": 7.0, "code": 730.0, "procedural": 30.0, "science": 90.0, "semantic": 365.0}
OTHER_RECENCY_DAYS = 30.0
# Weights of the final score.
FINAL_WEIGHTS = {"relevance": 0.25, "importance": 0.10, "recency": 0.10, "diversity": 0.05, "attribute": 0.50, "bm25": 0.10}
# Weights that the adaptive weighter starts from.
START_WEIGHTS = {
    "semantic": 0.20, "importance": 0.08, "recency": 0.05, "token": 0.07, "feedback": 0.02,
    "entity": 0.23, "subject": 0.20, "attribute": 0.15, "tfidf": 0.08, "bm25": 0.10,
}


@dataclass(frozen=True)
class Settings:
    """Limits and constants; every operator takes one and has these defaults."""

    top_k: int = 500
    source_k: int = 150
    graph_k: int = 50
    candidate_cap: int = 300
    context_size: int = 50
    min_score: float = 0.15
    token_budget: int = 10_000
    response_limit: int = 100
    k1: float = 1.5
    b: float = 0.75
    prune_importance: float = 0.1
    prune_days: int = 365
    decay_rate: float = 0.001
    decay_floor: float = 0.1
    feedback_decay: float = 0.95
    cluster_distance: float = 0.85
    cluster_batch: int = 500
    mmr_lambda: float = 0.85
    now: str = "2025-02-01 00:00:00"
    final_weights: dict = field(default_factory=lambda: dict(FINAL_WEIGHTS))
