"""Names, lists and tables that results depend on."""

from __future__ import annotations

# Event type -> short payload name.
PAYLOAD_NAMES = {
    "CommitCommentEvent": "CommitComment",
    "CreateEvent": "Create",
    "DeleteEvent": "Delete",
    "ForkEvent": "Fork",
    "GollumEvent": "Gollum",
    "IssueCommentEvent": "IssueComment",
    "IssuesEvent": "Issue",
    "MemberEvent": "Member",
    "PublicEvent": "Public",
    "PullRequestEvent": "PullRequest",
    "PullRequestReviewEvent": "PullRequestReview",
    "PullRequestReviewCommentEvent": "PullRequestReviewComment",
    "PushEvent": "Push",
    "ReleaseEvent": "Release",
    "SponsorshipEvent": "Sponsorship",
    "WatchEvent": "Watch",
    "WorkflowDispatchEvent": "WorkflowDispatch",
    "WorkflowJobEvent": "WorkflowJob",
    "WorkflowRunEvent": "WorkflowRun",
}

# Suffix that marks an automated account.
BOT_SUFFIX = "[bot]"

# Event families. Each event type maps to the qualifying column
# and its accepted values, or to None when every such event counts.
CREATION = {"CreateEvent": ("create_ref_type", ["repository"])}

POPULARITY = {
    "WatchEvent": ("action", ["started"]),
    "ForkEvent": None,
    "ReleaseEvent": ("action", ["published"]),
}

ENGAGEMENT = {
    "IssuesEvent": ("action", ["opened", "reopened"]),
    "IssueCommentEvent": ("action", ["created"]),
}

COLLABORATION = {
    "PullRequestEvent": ("action", ["opened", "reopened", "synchronize"]),
    "PullRequestReviewEvent": ("action", ["submitted"]),
    "PullRequestReviewCommentEvent": ("action", ["created"]),
    "CommitCommentEvent": ("action", ["created"]),
}

CORE_WORKFLOW = {
    "PushEvent": None,
    "CreateEvent": ("create_ref_type", ["branch"]),
    "DeleteEvent": ("delete_ref_type", ["branch"]),
    "IssuesEvent": ("action", ["opened", "reopened", "closed"]),
    "PullRequestEvent": ("action", ["opened", "reopened", "closed", "synchronize"]),
    "IssueCommentEvent": ("action", ["created"]),
    "PullRequestReviewCommentEvent": ("action", ["created"]),
    "CommitCommentEvent": ("action", ["created"]),
    "PullRequestReviewEvent": None,
    "ReleaseEvent": ("action", ["published"]),
}

# Column whose value is appended to the event type to name a step.
STEP_SUFFIX = {
    "PullRequestEvent": "action",
    "IssuesEvent": "action",
    "IssueCommentEvent": "action",
    "PullRequestReviewCommentEvent": "action",
    "CommitCommentEvent": "action",
    "ReleaseEvent": "action",
    "PullRequestReviewEvent": "review_state",
    "CreateEvent": "create_ref_type",
    "DeleteEvent": "delete_ref_type",
}

# The activities that span every adjacency matrix, sorted.
SKELETON = (
    "CommitCommentEvent_created",
    "CreateEvent_branch",
    "DeleteEvent_branch",
    "IssueCommentEvent_created",
    "IssuesEvent_closed",
    "IssuesEvent_opened",
    "IssuesEvent_reopened",
    "PullRequestEvent_closed",
    "PullRequestEvent_merged",
    "PullRequestEvent_opened",
    "PullRequestEvent_rejected",
    "PullRequestEvent_reopened",
    "PullRequestEvent_synchronize",
    "PullRequestReviewCommentEvent_created",
    "PullRequestReviewEvent_approved",
    "PullRequestReviewEvent_changes_requested",
    "PullRequestReviewEvent_commented",
    "PushEvent",
    "ReleaseEvent_published",
)

# The measured dimensions, in the order of the stratum id.
DIMENSIONS = (
    "workload",
    "collaboration_intensity",
    "community_engagement",
    "external_popularity",
)
METRICS = tuple(f"{d}_cum" for d in DIMENSIONS) + tuple(f"{d}_norm" for d in DIMENSIONS)

# Archetype -> accepted categories per normalised dimension.
# A repository may satisfy several: the last one is contained in the one before.
ARCHETYPES = {
    "Giant_All": {
        "external_popularity": ["Giant"],
        "collaboration_intensity": ["Giant"],
        "workload": ["Giant"],
        "community_engagement": ["Giant"],
    },
    "Giant_Pop_LowCollab": {
        "external_popularity": ["Giant"],
        "collaboration_intensity": ["Low", "Zero"],
        "workload": ["Giant"],
        "community_engagement": ["Low", "Zero"],
    },
    "Giant_Collab_LowPop": {
        "external_popularity": ["Low", "Zero"],
        "collaboration_intensity": ["Giant"],
        "workload": ["Giant"],
        "community_engagement": ["Giant"],
    },
    "High_Perf_Balanced": {
        "external_popularity": ["High", "Medium"],
        "collaboration_intensity": ["High", "Medium"],
        "workload": ["High", "Medium"],
        "community_engagement": ["High", "Medium"],
    },
    "Mid_Standard": {
        "external_popularity": ["Medium"],
        "collaboration_intensity": ["Medium"],
        "workload": ["Medium"],
        "community_engagement": ["Medium"],
    },
}
ARCHETYPE_NAMES = tuple(ARCHETYPES)

# The two groups shown in the ratio-to-max profile.
PROFILED_ARCHETYPES = ("Giant_All", "Giant_Pop_LowCollab")

# Outcome of one requested hour.
SUCCESS = "SUCCESS"
SKIPPED_PROCESSED = "SKIPPED_PROCESSED"
SKIPPED_404 = "SKIPPED_404"
FAILED_404 = "FAILED_404"
FAILED_OTHER = "FAILED_OTHER"

# State of an hour in the ledger.
PROCESSED = "processed"
NOT_FOUND = "not_found"
