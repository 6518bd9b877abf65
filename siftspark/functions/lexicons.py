"""Fixed values of the signal filter and the text classifiers; they must equal the established ones for equal results."""

#: Pain keywords by category.
PAIN = {
    "frustration": ["frustrated", "annoying", "hate", "terrible", "awful", "stuck", "broken", "failed", "error", "bug", "issue", "problem", "waste", "pointless", "useless"],
    "inefficiency": ["too slow", "takes too long", "manual", "tedious", "time-consuming", "inefficient", "workaround", "hack", "clunky", "complicated", "difficult"],
    "workflow": ["process", "workflow", "pipeline", "routine", "daily", "repetitive", "automation", "streamline", "optimize"],
    "cost": ["expensive", "costly", "price", "fee", "charge", "pay", "afford", "budget", "money"],
    "life_frustration": ["can't keep up", "too much work", "overwhelmed", "stressful", "exhausting", "dreading", "avoiding", "procrastinating"],
    "daily_inefficiency": ["forget to", "keep forgetting", "missed", "lost track", "disorganized", "chaotic", "hard to find", "can't find"],
    "value_concern": ["not worth it", "too expensive", "overpriced", "rip off", "waste of money", "can't justify"],
}
PAIN_WEIGHTS = {"frustration": 1.0, "inefficiency": 0.8, "complexity": 0.7, "workflow": 0.9, "cost": 0.6}
#: Aspiration keywords by category.
ASPIRATION = {
    "forward_looking": ["wish i had", "if only there was", "my dream tool would", "would be amazing if", "i wish someone would build", "someone should make", "looking for a tool that", "need a way to"],
    "opportunity": ["there should be a", "why isn't there a", "can't believe no one has", "surprised there's no", "would pay for", "would subscribe to"],
    "workflow_gap": ["manual process", "currently i have to", "still doing manually", "tired of doing", "hate that i have to"],
    "feature_wish": ["wish it could", "if it could also", "needs to have", "should include", "would be better if"],
}
ASPIRATION_WEIGHTS = {"forward_looking": 1.0, "opportunity": 0.9, "workflow_gap": 0.8}
OTHER_WEIGHT = 0.5
#: Exclusion patterns by category, in order.
EXCLUDE = {
    "showcase": ["check out my", "just launched", "i made", "my project", "showcase", "demo"],
    "job": ["hiring", "we are looking", "job opening", "apply now", "recruiting"],
    "question": ["any recommendations", "looking for advice"],
    "off_topic": ["meme", "general"],
    "personal_story": ["my story", "personal experience", "vent", "rant", "just need to share"],
    "advice_seeking": ["what do you think", "advice needed", "should i", "need advice on"],
}
#: Sentence patterns: required ones, then strong signals.
PATTERNS = ["struggling with", "having trouble", "can't figure out", "doesn't work", "broken", "frustrated", "annoying", "waste of time", "inefficient", "complicated"]
#: Words of emotion with the weight of their intensity.
EMOTION = {
    1.0: ["frustrated", "frustrating", "annoying", "annoyed", "hate", "terrible", "awful", "horrible", "disaster", "catastrophe", "nightmare", "hell", "impossible", "useless", "worthless", "broken", "crashed", "failed"],
    0.6: ["difficult", "hard", "struggling", "trouble", "problem", "issue", "challenge", "confusing", "complicated", "complex", "slow", "tedious"],
    0.3: ["annoyance", "minor", "slight", "inconvenient", "suboptimal", "could be better"],
}
QUICK_EMOTION = ["frustrated", "annoying", "struggling", "can't", "doesn't work", "broken"]
#: Kinds of pain with their keywords, in order.
PAIN_TYPES = {
    "workflow": ["workflow", "process", "flow", "pipeline", "automation"],
    "technical": ["code", "programming", "development", "technical", "bug"],
    "efficiency": ["slow", "time", "inefficient", "productivity", "performance"],
    "complexity": ["complex", "complicated", "difficult", "hard", "confusing"],
    "integration": ["integration", "connect", "api", "compatibility", "sync"],
    "cost": ["expensive", "cost", "price", "pricing", "budget"],
    "user_experience": ["ui", "ux", "interface", "usability", "experience"],
    "data": ["data", "database", "storage", "backup", "analysis"],
}
TOOLS = ["excel", "google sheets", "slack", "discord", "jira", "trello", "asana", "github", "gitlab", "vscode", "intellij", "docker", "kubernetes", "aws", "azure", "gcp", "mysql", "postgresql", "mongodb", "redis", "figma", "sketch", "photoshop", "wordpress", "shopify", "salesforce"]
GENERIC_PROBLEMS = ["it's slow", "it's bad", "it doesn't work", "it's broken", "i don't like it", "it's annoying", "it's frustrating"]
#: Frequency words and scores; the first that a text holds counts.
FREQUENCY = {"daily": 10, "每天": 10, "day": 9, "weekly": 8, "每周": 8, "week": 7, "monthly": 6, "每月": 6, "month": 5, "often": 7, "经常": 7, "frequently": 8, "sometimes": 5, "有时": 5, "occasionally": 4, "rarely": 3, "很少": 3, "seldom": 2, "always": 9, "总是": 9, "constantly": 8, "never": 1, "从不": 1}
FREQUENCY_DEFAULT = 4
#: A second, separate frequency scale: any of the words, score.
FREQUENCY_COARSE = [(["daily", "every day"], 10), (["weekly", "every week"], 8), (["monthly", "every month"], 6), (["often", "frequent"], 7), (["sometimes", "occasional"], 4), (["rarely"], 2)]
FREQUENCY_COARSE_DEFAULT = 5
#: Competing products by category.
COMPETITORS = {
    "automation": ["zapier", "ifttt", "integromat", "make.com"],
    "data_analysis": ["tableau", "power bi", "looker", "metabase"],
    "project_management": ["jira", "trello", "asana", "monday.com"],
    "documentation": ["notion", "confluence", "obsidian", "roam research"],
    "api_tools": ["postman", "insomnia", "swagger", "openapi"],
    "monitoring": ["datadog", "new relic", "grafana", "prometheus"],
    "testing": ["jest", "cypress", "selenium", "playwright"],
    "development": ["vs code", "github", "gitlab", "intellij"],
    "communication": ["slack", "discord", "teams", "zoom"],
}
#: Kinds of post by a substring of the subreddit, in order, and the least (upvotes, comments) of a kind.
POST_TYPES = {"technical": ["programming", "sysadmin", "webdev", "technical"], "business": ["entrepreneur", "startups", "business"], "discussion": ["discussion"]}
POST_TYPE_LEAST = {"technical": (10, 5), "business": (15, 8), "discussion": (5, 15)}
#: Trust below the bound: least comments, upvotes and engagement; the last tier has no bound.
TRUST_TIERS = [(0.5, (20, 50, 0.6)), (0.7, (10, 25, 0.4)), (None, (5, 10, 0.2))]
CATEGORY_TRUST = {"core": 0.9, "secondary": 0.7, "verticals": 0.6, "experimental": 0.4}
TRUST_DEFAULT = 0.5
#: Codes of a post that passes the gates but neither path.
FAILURES = ["insufficient_keywords", "low_emotional_intensity", "low_overall_score"]
#: Of a comment: least score, length, pain score, keywords, emotion and engagement.
COMMENT_LEAST = {"score": 10, "length": 30, "pain": 0.3, "keywords": 2, "emotion": 0.2, "engagement": 0.1}
#: Gate before a cluster is worked on: least size, authors, subreddits and mean frequency.
CLUSTER_LEAST = {"size": 5, "authors": 4, "subreddits": 1, "frequency": 5.0}
