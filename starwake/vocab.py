"""Word lists, limits and texts that decide results.

They are data agreed with the producers and readers of these reports, not logic.
"""

HOST_URL = "https://github.com/"

STAR_EVENT = "WatchEvent"
KNOWN_EVENT_TYPES = ["WatchEvent", "ForkEvent", "PushEvent", "CreateEvent", "IssuesEvent"]

MAX_REPO_ID = 10**12

# Categories in order of priority, each with its exact topics.
OTHER = "Other"
CATEGORY_TOPICS = {
    "LLM": [
        "llm", "transformer", "large-language-model", "fine-tuning", "pretrained-models",
        "language-model", "gpt", "bert", "llama", "mistral", "gemma", "phi", "falcon", "bloom",
        "qwen", "deepseek", "mixtral", "claude", "palm",
    ],
    "Agent": [
        "agent", "rag", "langchain", "multi-agent", "ai-agents", "autonomous-agent", "agentic",
        "tool-use", "function-calling", "retrieval-augmented-generation", "llamaindex", "autogpt",
        "crewai",
    ],
    "Diffusion": [
        "diffusion", "stable-diffusion", "image-generation", "text-to-image", "latent-diffusion",
        "stable-diffusion-webui", "img2img", "dalle", "midjourney",
    ],
    "Multimodal": [
        "multimodal", "vision-language", "vlm", "audio", "speech", "speech-recognition",
        "text-to-speech", "vision", "ocr", "image-captioning", "video-understanding",
    ],
    "DataEng": [
        "vector-db", "embedding", "embeddings", "vector-search", "similarity-search",
        "huggingface", "model-hub", "dataset", "annotation", "mlops", "feature-store",
        "data-pipeline", "knowledge-graph",
    ],
}

# Substrings of the description that decide when no topic does.
CATEGORY_PHRASES = {
    "LLM": ["large language model", "llm", "language model", "deepseek"],
    "Agent": ["agent", "retrieval augmented", "rag pipeline", "agentic"],
    "Diffusion": ["stable diffusion", "image generation", "diffusion model"],
    "Multimodal": ["multimodal", "vision language", "speech recognition"],
    "DataEng": ["vector database", "embedding", "vector store", "knowledge graph"],
}

# Substrings of the loose classifier used for repositories found through events.
LOOSE_CATEGORY_WORDS = {
    "LLM": [
        "llm", "gpt", "chatgpt", "language-model", "language model", "transformer", "bert", "t5",
        "llama", "mistral", "gemma", "phi", "falcon", "alpaca",
    ],
    "Agent": [
        "agent", "rag", "retrieval", "langchain", "langgraph", "crewai", "autogen", "multi-agent",
        "autonomous", "tool-calling",
    ],
    "Diffusion": [
        "diffusion", "stable-diffusion", "image-generation", "text-to-image", "midjourney",
        "dall-e", "flux", "comfyui", "inpainting",
    ],
    "Multimodal": [
        "multimodal", "vision", "vqa", "clip", "image-text", "video", "speech", "audio", "whisper",
        "tts", "asr",
    ],
    "DataEng": [
        "embedding", "vector", "qdrant", "milvus", "faiss", "pinecone", "data", "etl", "pipeline",
        "spark", "kafka", "dbt",
    ],
}

# Substrings that mark a repository text as AI related.
AI_SIGNAL_WORDS = [
    "ai", "ml", "machine learning", "deep learning", "neural network", "generative ai", "llm",
    "large language model", "language model", "agent", "rag", "embedding", "vector database",
    "multimodal", "diffusion", "stable diffusion", "computer vision", "speech recognition",
]

# Patterns of the question reader.
REPO_MENTION = "[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+"
SEARCH_QUESTION = r"(?i)\b(search|find|tim|tim kiem|goi y|repo ve|repositories about)\b"
KNOWLEDGE_QUESTION = (
    r"(?i)\b(trend|trending|tang|hot|breakout|sao|star|category|topic|phan tich|"
    r"chu de|danh muc|nhom|rotation|dich chuyen|nhanh nhat|noi bat)\b"
)
TOPIC_QUESTION = r"(?i)\b(topic|topics|tag|tags|chu de|stack|cong nghe)\b"
CATEGORY_QUESTION = r"(?i)\b(category|categories|danh muc|nhom|phan khuc)\b"
QUERY_TERM = "[a-z0-9][a-z0-9+.#/-]*"

# Texts of the answers given without a model (printf patterns).
ANSWER_TEXTS = {
    "instant": "Xin loi, minh chua the tra loi cau hoi nay ngay luc nay.",
    "repo_verdict": "%s dang duoc xep la %s.",
    "repo_window": "Trong %d ngay: +%d stars, %d events, %d actors.",
    "repo_reason": "Ly do chinh: %s",
    "topics_title": "Cac topic dang co chuyen dong manh nhat:",
    "topics_line": "%d. %s: +%d stars tren %d repos.",
    "categories_title": "Cac category noi bat trong cua so hien tai:",
    "categories_line": "%d. %s: %d active repos, +%d stars, leader %s.",
    "evidence_title": "Minh da truy van du lieu that va thay cac tin hieu chinh sau:",
    "evidence_line": "- %s: %s (%s)",
    "search_title": "Cac repo khop nhat voi cau hoi cua ban:",
    "search_line": "%d. %s: score %.2f, +%d stars.",
}
FOLLOW_UPS = {
    "instant": [
        "Repo nao dang tang sao nhanh nhat?",
        "Topic nao dang nong trong 7 ngay?",
        "Tim repo ve AI agents",
    ],
    "search": [
        "Loc ket qua chi Python",
        "Repo nao co momentum tot nhat trong nhom nay?",
        "Hay phan tich repo dau tien",
    ],
    "knowledge": [
        "Category nao dang tang nhanh nhat?",
        "Topic nao co rotation manh nhat?",
        "Repo nao nen theo doi tiep?",
    ],
    "repo": [
        "So sanh %s voi repo trending khac",
        "Tim cac repo lien quan den %s",
        "%s co watchout nao dang chu y?",
    ],
}

# Evidence lines and their sources (printf patterns).
EVIDENCE_TEXTS = {
    "breakout": ("+%d stars, %d events, %d actors", "/ai/market-brief.breakout_repos"),
    "category": ("%d active repos, +%d stars, leader %s", "/ai/market-brief.category_movers"),
    "topic": ("+%d stars across %d repos", "/ai/market-brief.topic_shifts"),
    "search": ("score %.2f, +%d stars, %s", "/ai/search.results"),
    "repo": ("%s: +%d stars, %d events, %d actors", "/ai/repo-brief"),
}

# Reasons shown with search results (printf patterns).
SEARCH_REASONS = {
    "name": "Repo identity matches: %s.",
    "topic": "Topic overlap: %s.",
    "language": "Language signal: %s.",
    "category": "Category signal: %s.",
    "description": "Description mentions: %s.",
    "phrase": "Query phrase appears in repository metadata.",
    "semantic": "Semantic reranker found a strong conceptual match.",
    "momentum": "Recent momentum: +%s stars in %dd.",
    "established": "Established project with %s total stars.",
}

# Reasons shown with related repositories (printf patterns).
RELATED_REASONS = {
    "topics": "Shared topics: %s.",
    "category": "Same category: %s.",
    "language": "Same language stack: %s.",
    "scale": "Comparable ecosystem scale by GitHub stars.",
    "momentum": "Recent momentum sits in a similar range.",
}

# Texts of the comparison report (printf patterns).
COMPARE_TEXTS = {
    "headline_tie": "%s and %s trade off momentum and ecosystem depth.",
    "headline": "%s has the stronger overall signal in the current window.",
    "summary_tie": (
        "%s and %s look balanced overall: one leads in some metrics while the other holds up on "
        "recent adoption or ecosystem breadth."
    ),
    "summary": (
        "%s currently leads with %s stars and %s active actors in the last %d days, while %s still "
        "remains relevant on specialization or installed base."
    ),
    "difference": "%s leads on %s (%s vs %s).",
    "difference_category": "The pair spans different categories: %s vs %s.",
    "choose": "Choose %s when you want a %s repo in %s.",
    "choose_stack": "its current stack",
    "choose_momentum": "It has the stronger recent star momentum in the last %d days.",
    "choose_actors": "It currently shows broader recent actor participation.",
    "choose_forks": "Its fork base suggests a broader builder ecosystem.",
}

# Texts of the repository report (printf patterns).
REPO_BRIEF_TEXTS = {
    "headline": "%s is %s in %s with +%s stars over %dd.",
    "summary": (
        "%s is a %s repository in %s with %s total stars, %s events, and %s active actors in the "
        "last %d days."
    ),
    "unknown_language": "unknown stack",
    "dominant": "%s led activity with %s events",
    "no_dominant": "activity was spread across a small number of events",
    "why_accelerating": (
        "Momentum is accelerating because the repo added %s stars in %dd and the recent daily star "
        "rate (%s) is ahead of the prior half-window (%s); %s."
    ),
    "why_steady": (
        "The repo is sustaining attention with %s recent events from %s actors; %s."
    ),
    "why_emerging": (
        "The signal is early but real: %s stars and %s events appeared in the last %dd; %s."
    ),
    "why_quiet": (
        "Current activity is muted. The repo still has %s total stars, but only %s recent events "
        "were observed."
    ),
    "signal_stars": "%s total GitHub stars with +%s in the last %dd.",
    "signal_events": "%s tracked events from %s unique actors in the current window.",
    "signal_dominant": "%s is the dominant activity type at %s events.",
    "signal_language": "Primary implementation language is %s.",
    "watch_breadth": (
        "Attention is rising faster than contributor breadth, so momentum may be audience-led."
    ),
    "watch_push": (
        "Latest GitHub push is %d days old, so shipping cadence may lag attention."
    ),
    "watch_sparse": (
        "Repository metadata is sparse, which weakens downstream semantic understanding."
    ),
    "watch_no_events": "No recent tracked events were observed in the selected window.",
    "watch_none": (
        "Current signal is mostly event-driven; deeper README and issue analysis is still pending."
    ),
}

# Texts of the market report (printf patterns).
MARKET_BRIEF_TEXTS = {
    "quiet_headline": "GitHub AI activity looks quiet across the last %d days.",
    "quiet_summary": (
        "No breakout repositories met the current threshold, so the market brief is showing a "
        "low-signal window."
    ),
    "quiet_takeaways": [
        "Breakout activity is currently thin in the selected window.",
        "Category rotation is muted, so dashboard users should widen the date range.",
    ],
    "quiet_watchout": "Sparse event volume limits confidence in short-window conclusions.",
    "headline": "%s leads the %dd cycle with +%s stars.",
    "summary_breakout": (
        "%s is the strongest breakout with %s total events and %s distinct actors."
    ),
    "summary_category": "%s is absorbing the most star flow, led by %s.",
    "summary_topic": "The hottest topic signal is %s, appearing across %d active repositories.",
    "summary_many": (
        "%d breakout repos are strong enough to surface in this window, which suggests "
        "concentrated rather than broad-based momentum."
    ),
    "take_breakout": "%s leads on near-term attention with +%s stars and %s active actors.",
    "take_runner_up": (
        "%s is the next breakout, indicating the field is not a single-repo story."
    ),
    "take_category": "%s is the strongest category mover with %s stars in the window.",
    "take_topic": "%s is the clearest topic shift, spanning %d repositories.",
    "watch_single": (
        "A single breakout repo is capturing more than half of the surfaced star flow."
    ),
    "watch_category": "%s dominates the current window, so cross-category breadth is limited.",
    "watch_topics": "Topic breadth is narrow, so trend rotation is still early.",
    "watch_none": (
        "Momentum is distributed enough that rankings may reshuffle quickly in the next run."
    ),
}
