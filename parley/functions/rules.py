"""Rule catalog: the classification constants.

Everything below the "Fixed values" marker must equal the behaviour we
reproduce (order is significant in every list: first match wins, ties go
to the earlier label).  The rest of the library only reads these through
a :class:`RuleSet`, so a deployment can pass its own catalog.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (patterns, keyword lists, labels). Do not reorder.
# ---------------------------------------------------------------------------

PROMPT_INJECTION = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions|prompts|rules)",
    r"you\s+are\s+now\s+(a|an)\s+",
    r"pretend\s+(to\s+be|you\s+are)",
    r"disregard\s+(your|all)\s+(rules|guidelines|instructions)",
    r"override\s+(safety|guardrails|filters|restrictions)",
    r"jailbreak",
    r"DAN\s+mode",
    r"act\s+as\s+if\s+you\s+have\s+no\s+restrictions",
    r"system\s*prompt",
]

ACADEMIC_INTEGRITY = [
    r"\b(solve|complete|finish|do)\b.*\b(assignment|homework|quiz|exam|test|project)\b",
    r"\b(give|provide|send|write)\b.*\b(answer|solution|code|essay|submission)\b",
    r"\b(full|complete|entire|whole)\b.*\b(answer|solution|code|assignment|homework)\b",
    r"\bsolve\s+(question|problem|q)\s*\d+\b",
    r"\bwrite\s+(my|the|this)\b.*\b(essay|report|paper|code|program)\b",
    r"\bcopy\s*paste\b.*\b(answer|solution)\b",
    r"\bdo\s+(my|this|the)\s+(homework|assignment|project|lab)\b",
    r"\bjust\s+give\s+(me\s+)?(the\s+)?answer\b",
]

TOXICITY = [
    r"\b(stupid|idiot|dumb|useless|garbage|trash|pathetic)\b.*\b(bot|ai|system|platform|app)\b",
    r"\b(hate|kill|die|destroy|attack)\b",
    r"\b(shut\s*up|go\s*away|f\s*u\s*c\s*k|s\s*h\s*i\s*t|a\s*s\s*s)\b",
    r"\b(harassment|threaten|bully|abuse)\b",
]

PRIVACY = [
    r"\b(ssn|social\s+security|tax\s+id)\b",
    r"\b(password|credentials|login\s+details)\b.*\b(other|another|someone)\b",
    r"\bshow\s+me\s+.*\b(grades|records|data)\s+of\s+",
    r"\baccess\s+.*\bstudent\s+(records|data|information|profile)\b",
]

OUTPUT_MODERATION = [
    r"here\s+is\s+the\s+(complete|full|final)\s+(solution|answer|code)",
    r"the\s+answer\s+(is|to\s+the\s+assignment)\s*:",
    r"submit\s+this\s+(as|for)\s+your\s+(assignment|homework)",
]

INTENT_KEYWORDS = {
    "course": [
        "explain", "concept", "understand", "what is", "how does", "teach me",
        "learn", "study", "tutorial", "theory", "definition", "example of",
        "tell me about", "describe", "course", "topic", "subject", "module",
        "recursion", "algorithm", "data structure", "programming", "math",
        "physics", "chemistry", "biology", "history", "literature",
        "study plan", "resources", "recommend", "guide me",
    ],
    "assignment": [
        "assignment", "homework", "quiz", "exam", "test", "project",
        "question", "problem set", "lab", "exercise", "graded",
        "submission", "due date", "deadline", "marks", "rubric",
        "help with assignment", "assignment help", "hint", "guidance",
        "how to approach", "clarification",
    ],
    "technical": [
        "login", "password", "video", "buffering", "upload", "download",
        "error", "bug", "crash", "loading", "slow", "not working",
        "broken", "payment", "access", "locked", "subscription",
        "account", "profile", "settings", "browser", "app", "mobile",
        "notification", "email", "certificate", "reset", "install",
    ],
    "escalation": [
        "human", "person", "agent", "supervisor", "manager",
        "escalate", "complaint", "frustrated", "angry", "terrible",
        "wrong grade", "grade dispute", "unfair", "unacceptable",
        "speak to someone", "real person", "not helpful",
    ],
}

ESCALATION_PHRASES = [
    "talk to a human", "speak to someone", "real person",
    "human agent", "escalate", "supervisor", "manager",
    "not helpful", "this isn't working", "connect me to",
    "human support", "speak to agent", "real support",
]

GRADING_PHRASES = [
    "wrong grade", "grading error", "grade dispute",
    "unfair grade", "regrading", "grade appeal",
    "my grade is wrong", "incorrect marks",
]

FRUSTRATION_WORDS = ["frustrated", "angry", "annoyed", "terrible", "worst", "horrible", "useless"]

COURSE_TOPICS = {
    "linear regression": ["linear regression", "regression line", "best fit line", "least squares"],
    "binary search": ["binary search", "binary find", "search algorithm sorted"],
    "recursion": ["recursion", "recursive", "base case", "recursive function"],
    "sorting": ["sorting", "bubble sort", "merge sort", "quick sort", "selection sort", "insertion sort", "sort algorithm"],
    "big o": ["big o", "time complexity", "space complexity", "algorithm complexity", "o(n)", "o(1)"],
    "oop": ["oop", "object oriented", "encapsulation", "inheritance", "polymorphism", "abstraction", "class and object"],
    "stack": ["stack", "lifo", "push pop"],
    "queue": ["queue", "fifo", "enqueue", "dequeue"],
}

HINT_TOPICS = {
    "recursion": ["recursion", "recursive", "base case", "factorial", "fibonacci"],
    "sorting": ["sort", "sorting", "bubble", "merge sort", "quick sort", "selection sort"],
    "sql": ["sql", "query", "database", "select", "join", "table"],
    "loop": ["loop", "for loop", "while loop", "iteration", "iterate", "repeat"],
    "array": ["array", "list", "index", "element", "matrix"],
}

QUICK_KEYS = ["login", "video", "upload", "payment"]

# search-query cleanup: applied in order, each followed by a strip
QUERY_CLEANUP = ["explain ", "what is ", "tell me about ", "concept of ", "how does ", " work", "?", "the "]

# agent for each intent label; unknown labels go to "course"
AGENT_FOR_INTENT = {"course": "course", "assignment": "assignment", "technical": "technical", "escalation": "escalation"}

# dashboard display labels for agent types (unknown types show as-is)
AGENT_LABELS = {"course": "Course Guide", "assignment": "Assignment Help", "technical": "Tech Support", "escalation": "Escalation"}

ESCALATION_REASONS = ["student_request", "grading_dispute", "repeated_frustration", "policy_violation"]

# frame sizes of the context slices
FRUSTRATION_FRAME = 4
FRUSTRATION_MIN = 2
MODEL_CONTEXT_FRAME = 6
HANDOFF_FRAME = 5

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class RuleSet:
    """Ordered rule catalog passed to the column builders."""

    checks: tuple = (
        ("prompt_injection", "high", tuple(PROMPT_INJECTION)),
        ("academic_integrity", "high", tuple(ACADEMIC_INTEGRITY)),
        ("toxicity", "medium", tuple(TOXICITY)),
        ("privacy", "high", tuple(PRIVACY)),
    )
    output_moderation: tuple = tuple(OUTPUT_MODERATION)
    intent_keywords: tuple = tuple((k, tuple(v)) for k, v in INTENT_KEYWORDS.items())
    escalation_phrases: tuple = tuple(ESCALATION_PHRASES)
    grading_phrases: tuple = tuple(GRADING_PHRASES)
    frustration_words: tuple = tuple(FRUSTRATION_WORDS)
    course_topics: tuple = tuple((k, tuple(v)) for k, v in COURSE_TOPICS.items())
    hint_topics: tuple = tuple((k, tuple(v)) for k, v in HINT_TOPICS.items())
    quick_keys: tuple = tuple(QUICK_KEYS)
    query_cleanup: tuple = tuple(QUERY_CLEANUP)
    frustration_frame: int = FRUSTRATION_FRAME
    frustration_min: int = FRUSTRATION_MIN

    def check(self, name: str):
        for n, sev, pats in self.checks:
            if n == name:
                return n, sev, pats
        raise KeyError(name)

    @property
    def intent_labels(self) -> list[str]:
        return [k for k, _ in self.intent_keywords]


DEFAULT_RULES = RuleSet()
