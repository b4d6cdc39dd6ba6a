"""Seed rows of the platform (S14), as DataFrames with a fixed clock.

Used by tests and examples; ``now`` is a parameter so results are
reproducible.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from parley.sources.schemas import SCHEMAS

NOW = dt.datetime(2024, 1, 10, 12, 0, 0)


def _h(p: str) -> str:
    return hashlib.sha256(p.encode()).hexdigest()


# ---------------------------------------------------------------------------
# Seed rows.
# ---------------------------------------------------------------------------
USERS = [
    ("student1", "student123", "Arjun Mehta", "arjun@edu.com", "student", ["CS101", "MATH201"]),
    ("student2", "student123", "Priya Sharma", "priya@edu.com", "student", ["CS101", "ENG102"]),
    ("student3", "student123", "Rahul Kumar", "rahul@edu.com", "student", ["MATH201", "PHY301"]),
    ("admin", "admin123", "Dr. Admin", "admin@edu.com", "admin", []),
    ("faculty1", "faculty123", "Prof. Verma", "verma@edu.com", "faculty", ["CS101"]),
]
COURSES = [
    ("CS101", "Introduction to Computer Science", "Prof. Verma", "Computer Science", "beginner",
     ["Variables & Data Types", "Control Flow", "Functions", "OOP Basics", "Data Structures"]),
    ("MATH201", "Linear Algebra", "Prof. Gupta", "Mathematics", "intermediate",
     ["Vectors", "Matrices", "Eigenvalues", "Linear Transformations", "Applications"]),
    ("ENG102", "Technical Writing", "Prof. Singh", "English", "beginner",
     ["Grammar Review", "Report Writing", "Documentation", "Research Papers", "Presentations"]),
    ("PHY301", "Quantum Mechanics", "Prof. Das", "Physics", "advanced",
     ["Wave Functions", "Schrodinger Equation", "Quantum States", "Entanglement", "Applications"]),
]
TICKETS = [  # user, category, subject, description, status, priority, resolution, age, resolved
    (1, "technical", "Video not loading", "Course CS101 Module 3 video shows buffer error", "resolved", "high",
     "Cleared CDN cache, video restored", dt.timedelta(days=1), True),
    (2, "access", "Cannot access Assignment 2", "Getting 403 error when opening assignment link", "open",
     "medium", None, dt.timedelta(hours=3), False),
    (3, "payment", "Payment not reflected", "Paid for PHY301 but still shows locked", "in_progress", "high",
     None, dt.timedelta(hours=6), False),
]
CONVERSATIONS = [  # user, agent, title, age
    (1, "course", "Help with Recursion", dt.timedelta(hours=2)),
    (2, "assignment", "Assignment 3 Question", dt.timedelta(hours=5)),
]
MESSAGES = [  # conversation, role, content, agent, age (replies one minute after the question)
    (1, "user", "Can you explain how recursion works in Python?", None, dt.timedelta(hours=2)),
    (1, "assistant",
     "Recursion is when a function calls itself to solve a smaller version of the same problem. Think of it like "
     "Russian nesting dolls — each doll contains a smaller one inside.\n\n**Key Components:**\n1. **Base Case** — "
     "The condition that stops recursion\n2. **Recursive Case** — The function calling itself with a simpler "
     "input\n\n**Example:**\n```python\ndef factorial(n):\n    if n <= 1:  # Base case\n        return 1\n    "
     "return n * factorial(n - 1)  # Recursive case\n```\n\nWould you like me to walk through more examples or "
     "explain the call stack?", "course", dt.timedelta(hours=2, minutes=-1)),
    (2, "user", "I need help understanding question 3 of Assignment 2", None, dt.timedelta(hours=5)),
    (2, "assistant",
     "I'd be happy to help you understand the concepts behind Question 3! Let me guide you through the approach "
     "without giving the direct answer.\n\nThe question involves sorting algorithms. Here's how to think about "
     "it:\n\n1. **Understand what the question asks** — It's about comparing time complexities\n2. **Key "
     "concept** — Big-O notation measures worst-case performance\n3. **Hint** — Compare how each algorithm "
     "handles already-sorted data\n\nTry working through these steps and let me know where you get stuck! 📚",
     "assignment", dt.timedelta(hours=5, minutes=-1)),
]
VIOLATIONS = [
    (2, "academic_integrity", "Give me the complete answer for Assignment 2 Question 5", "blocked", "high"),
    (1, "academic_integrity", "Solve this exam question for me", "blocked", "high"),
    (3, "toxicity", "This platform is garbage, you stupid bot", "warned", "medium"),
]
# ---------------------------------------------------------------------------


def seed(spark: SparkSession, now: dt.datetime = NOW) -> dict[str, DataFrame]:
    users = [(i + 1, u, _h(p), d, e, r, json.dumps(c), now, None) for i, (u, p, d, e, r, c) in enumerate(USERS)]
    courses = [(i + 1, t, d, ins, cat, diff, json.dumps(m), now) for i, (t, d, ins, cat, diff, m) in enumerate(COURSES)]
    tickets = [(i + 1, u, c, s, d, st, pr, res, now - age, now if done else None)
               for i, (u, c, s, d, st, pr, res, age, done) in enumerate(TICKETS)]
    viol = [(i + 1, u, t, q, a, s, now) for i, (u, t, q, a, s) in enumerate(VIOLATIONS)]
    convs = [(i + 1, u, a, t, "active", now - age, now - age) for i, (u, a, t, age) in enumerate(CONVERSATIONS)]
    msgs = [(i + 1, c, r, txt, a, "{}", now - age) for i, (c, r, txt, a, age) in enumerate(MESSAGES)]
    return {
        "users": spark.createDataFrame(users, SCHEMAS["users"]),
        "courses": spark.createDataFrame(courses, SCHEMAS["courses"]),
        "support_tickets": spark.createDataFrame(tickets, SCHEMAS["support_tickets"]),
        "guardrail_violations": spark.createDataFrame(viol, SCHEMAS["guardrail_violations"]),
        "conversations": spark.createDataFrame(convs, SCHEMAS["conversations"]),
        "messages": spark.createDataFrame(msgs, SCHEMAS["messages"]),
        "analytics_events": spark.createDataFrame([], SCHEMAS["analytics_events"]),
        "escalations": spark.createDataFrame([], SCHEMAS["escalations"]),
    }
