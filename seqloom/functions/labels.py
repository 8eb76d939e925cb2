"""What decoded events are called: a label and a sign for each rule, fallback and known route."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label and sign of each decoder rule, in the order of the rules.
LABELS: list[tuple[str, str]] = [
    ("FB logging your screen time", "◎"),
    ("FB enforcing time limits", "◎"),
    ("FB logging product usage", "◎"),
    ("FB logging video seen", "◎"),
    ("FB showing a promotion", "◆"),
    ("FB logging an impression", "◎"),
    ("Ad pre-fetch", "◆"),
    ("Ad fetch", "◆"),
    ("Ad tracking", "◆"),
    ("Ad infra", "◆"),
    ("Presence ping", "●"),
    ("Presence heartbeat", "●"),
    ("User signals", "●"),
    ("Clearing notifications", "✓"),
    ("Clearing friends badge", "✓"),
    ("Clearing jewel badge", "✓"),
    ("Marking notification read", "✓"),
    ("Hovering a face", "◉"),
    ("Hovering (signals)", "◉"),
    ("Hovering engagement count", "◉"),
    ("Hovering", "◉"),
    ("Link preview", "◉"),
    ("Reacting", "♥"),
    ("Liking", "♥"),
    ("Unreacting", "-"),
    ("Reacting to a story", "♥"),
    ("Sending a message", "✉"),
    ("Sending a message", "✉"),
    ("Reading messages", "◉"),
    ("Typing a message", "✎"),
    ("Reacting to a message", "♥"),
    ("Unsending a message", "✕"),
    ("Encrypted backup", "◈"),
    ("Encrypted msg infra", "◈"),
    ("Secure messenger", "◈"),
    ("Messenger UI", "◈"),
    ("Messenger jewel", "◈"),
    ("Messenger platform", "◈"),
    ("Messenger media setting", "◈"),
    ("Messenger config", "◈"),
    ("Browsing messages", "◈"),
    ("Browsing inbox", "◈"),
    ("Biz call controls", "◈"),
    ("Business inbox", "◈"),
    ("RT web call", "◈"),
    ("Messenger activity", "◈"),
    ("Scrolling feed", "↓"),
    ("Refreshing feed", "↻"),
    ("Browsing home feed", "≡"),
    ("Feed stories", "◉"),
    ("Stories tray", "◉"),
    ("Viewing a story", "◉"),
    ("Browsing watch", "≡"),
    ("Watching a video", "▶"),
    ("Watching a video", "▶"),
    ("Video autoplay setting", "▶"),
    ("Switching account", "↻"),
    ("Updating profile", "✎"),
    ("Contextual profile", "◉"),
    ("Viewing a profile", "◉"),
    ("Profile directory", "◉"),
    ("Viewing a profile", "◉"),
    ("Browsing friends", "◉"),
    ("People panel", "◉"),
    ("Sidebar (ego)", "◉"),
    ("Posting a comment", "✎"),
    ("Editing a comment", "✎"),
    ("Deleting a comment", "✕"),
    ("Opening share sheet", "↗"),
    ("Sharing a post", "↗"),
    ("Sharing", "↗"),
    ("Sending friend request", "+"),
    ("Accepting friend request", "✓"),
    ("Following someone", "+"),
    ("Unfollowing", "-"),
    ("Joining a group", "+"),
    ("Saving", "★"),
    ("Hiding", "◌"),
    ("Reporting", "⚑"),
    ("Block-flow interstitial", "⊘"),
    ("Blocking user", "⊘"),
    ("Muting", "⊘"),
    ("Uploading media", "↑"),
    ("Publishing a post", "◆"),
    ("Creating a story", "◆"),
    ("Composing", "✎"),
    ("Searching", "◎"),
    ("Search bootstrap", "◎"),
    ("Keyword search", "◎"),
    ("Marketplace search", "◎"),
    ("Checking notifications", "◉"),
    ("Loading notifications", "◉"),
    ("Cross-group feed", "≡"),
    ("Groups sidebar", "↻"),
    ("Viewing groups", "◉"),
    ("Viewing a group", "◉"),
    ("Viewing a listing", "◉"),
    ("Browsing marketplace", "≡"),
    ("Viewing a post", "◉"),
    ("Viewing a photo", "◉"),
    ("Viewing photo tags", "◉"),
    ("Saved items", "★"),
    ("Reading comments", "◉"),
    ("Business nav", "↻"),
    ("Business inbox view", "◈"),
    ("Business page", "◉"),
    ("Business tools", "◈"),
    ("Loading route", "↻"),
    ("Relay infra", "↻"),
    ("Sidebar header", "↻"),
    ("Navigation UI", "↻"),
    ("Web storage", "↻"),
    ("Feature gating", "↻"),
    ("User preferences", "↻"),
    ("Listening for updates", "◌"),
    ("Adjusting settings", "◈"),
    ("Logging out", "⊘"),
    ("Loading page", "↻"),
]
#: Label and sign of names that no rule decodes, by rule id.
FALLBACKS: dict[int, tuple[str, str]] = {-1: ("Unknown activity", "◌"), -2: ("Performing action", "◆"), -3: ("Loading data", "≡")}
#: Label and sign of requests without a name, by what their path contains, in order of priority.
PATHS: list[tuple[str, str, str]] = [
    ("route-definition", "Loading route", "↻"),
    ("bulk-route", "Loading route", "↻"),
    ("unified_cvc", "Video CVC ping", "●"),
    ("webstorage", "Web storage sync", "↻"),
    ("navigation", "Navigation API", "↻"),
    ("gating", "Feature gating", "↻"),
    ("user_preferences", "User preferences", "↻"),
    ("graphql", "GraphQL (untagged)", "◌"),
]
#: The known routes and their surfaces.
SURFACES: dict[str, str] = {
    "comet.fbweb.CometHomeRoute": "HOME FEED",
    "comet.fbweb.CometProfileRoute": "PROFILE",
    "comet.fbweb.CometProfileTimelineListViewRoute": "PROFILE",
    "comet.fbweb.CometContextualProfileRoute": "PROFILE·CTX",
    "comet.fbweb.CometProfileDirectorySpecialtiesTabRoute": "PROFILE·DIR",
    "comet.fbweb.CometMessengerThreadRoute": "MESSENGER",
    "comet.fbweb.CometNotificationsRoute": "NOTIFICATIONS",
    "comet.fbweb.CometGroupRoute": "GROUP",
    "comet.fbweb.CometGroupsCrossGroupFeedRoute": "GROUPS FEED",
    "comet.fbweb.CometMarketplaceRoute": "MARKETPLACE",
    "comet.fbweb.CometWatchRoute": "WATCH",
    "comet.fbweb.CometFBVideoUnifiedRoute": "VIDEO",
    "comet.fbweb.CometSearchRoute": "SEARCH",
    "comet.fbweb.CometSettingsRoute": "SETTINGS",
    "comet.fbweb.CometPhotoRoute": "PHOTO",
    "comet.fbweb.CometSinglePostDialogRoute": "POST DIALOG",
    "comet.fbweb.CometSaveDashboardRoute": "SAVED",
    "comet.bizweb.BusinessCometBizSuiteInboxAllMessagesRoute": "BIZ INBOX",
}


def surface(route: Column) -> Column:
    """The surface of a known route, else null."""
    return F.get(F.array(*map(F.lit, SURFACES.values())), F.array_position(F.array(*map(F.lit, SURFACES)), route).cast("int") - 1)


def labelled(rule_id: Column, path: Column, route: Column, kind: Column) -> Column:
    """A struct (label, icon): by rule, fallback or path, else browsing the route's surface; sensors are their kind."""
    pair = lambda label, icon: F.struct(label.alias("label"), icon.alias("icon"))
    told = lambda t: pair(F.lit(t[0]), F.lit(t[1]))
    by_rule = F.get(F.array(*map(told, LABELS)), rule_id)
    by_path = F.coalesce(*(F.when(F.contains(path, F.lit(part)), told((label, icon))) for part, label, icon in PATHS))
    browsing = pair(F.concat(F.lit("Browsing "), F.lower(F.coalesce(surface(route), F.lit("Unknown")))), F.lit("≡"))
    out = F.when(kind != "request", pair(kind, F.lit("●"))).when(rule_id >= 0, by_rule)
    for number, t in FALLBACKS.items():
        out = out.when(rule_id == number, told(t))
    return out.when(rule_id == -4, by_path).otherwise(browsing)
