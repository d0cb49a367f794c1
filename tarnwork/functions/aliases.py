"""Topic aliases and their one-hop, symmetric closure."""

from __future__ import annotations

#: A topic and what it is also called.
TOPIC_ALIASES: dict[str, tuple[str, ...]] = {
    "nlp": ("natural language processing", "computational linguistics", "text analysis", "text mining"),
    "natural language processing": ("nlp", "computational linguistics"),
    "ml": ("machine learning", "statistical learning", "ai", "artificial intelligence", "deep learning", "neural network"),
    "machine learning": ("ml", "ai", "artificial intelligence", "deep learning", "neural network", "statistical learning"),
    "ai": ("artificial intelligence", "machine intelligence", "machine learning", "ml", "neural network"),
    "artificial intelligence": ("ai", "machine learning", "ml", "neural network"),
    "dl": ("deep learning", "neural networks", "machine learning", "ml"),
    "deep learning": ("dl", "neural networks", "machine learning", "ml"),
    "neural network": ("neural networks", "deep learning", "machine learning", "ml", "ai"),
    "neural networks": ("neural network", "deep learning", "machine learning", "ml", "ai"),
    "xai": ("explainable artificial intelligence", "explainable ai", "interpretable ml"),
    "explainable ai": ("xai",),
    "cv": ("computer vision", "image processing", "visual computing"),
    "computer vision": ("cv",),
    "hci": ("human-computer interaction", "human computer interaction", "user experience", "ux"),
    "human-computer interaction": ("hci",),
    "ux": ("user experience", "hci"),
    "css": ("computational social science", "social computing"),
    "computational social science": ("css",),
    "network science": ("networks", "social networks", "network analysis", "complex networks", "graph theory"),
    "networks": ("network science", "network analysis"),
    "social networks": ("network science", "social network analysis"),
    "sna": ("social network analysis", "network analysis"),
    "data science": ("data analytics", "data mining", "big data"),
    "big data": ("data science", "large-scale data"),
    "ir": ("information retrieval", "search engines"),
    "information retrieval": ("ir",),
    "science of science": ("scientometrics", "bibliometrics", "metascience"),
    "scientometrics": ("science of science", "bibliometrics"),
    "bibliometrics": ("scientometrics", "science of science"),
    "econ": ("economics", "economic"),
    "economics": ("econ",),
    "stats": ("statistics", "statistical"),
    "statistics": ("stats",),
    "rl": ("reinforcement learning",),
    "reinforcement learning": ("rl",),
    "nlu": ("natural language understanding",),
    "nlg": ("natural language generation",),
    "llm": ("large language models", "language models"),
    "large language models": ("llm",),
    "lda": ("latent dirichlet allocation", "topic modeling"),
    "topic modeling": ("lda", "topic models"),
    "hpc": ("high performance computing", "parallel computing", "distributed computing"),
    "high performance computing": ("hpc",),
    "iot": ("internet of things",),
    "internet of things": ("iot",),
}


def closure(topic: str, aliases: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """The topic and every family whose key or alias holds it as a substring, sorted."""
    table, wanted = TOPIC_ALIASES if aliases is None else aliases, topic.lower().strip()
    families = ({key, *names} for key, names in table.items() if wanted in key or any(wanted in n.lower() for n in names))
    direct = set(table.get(wanted, ()))
    return sorted({wanted}.union(direct, *families))
