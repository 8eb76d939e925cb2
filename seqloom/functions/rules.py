"""A rule table that decodes a request name to a category, and its fallbacks.

Rules are ordered, unanchored and case-insensitive; the first that matches counts.  The table below
is the default; any list of (pattern, category) takes its place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The decoder's patterns in order of priority, with the category of each.
RULES: list[tuple[str, str]] = [
    (r"ScreenTimeLogger|ScreenTime.*Sync", "self_surv"),
    (r"TimeLimitsEnforcement|FBYRPTimeLimit", "self_surv"),
    (r"RecordProductUsage", "self_surv"),
    (r"UnifiedVideoSeenState|VideoSeen.*Mutation", "self_surv"),
    (r"QuickPromotion|QPContainer|Upsell", "self_surv"),
    (r"ImpressionLogger|ImpressionTracking", "self_surv"),
    (r"InstreamAds|AdsHalo|AdsHaloFetcher", "ad"),
    (r"AdsBatch|AdsFetcher|SponsoredContent", "ad"),
    (r"AdsPlacement|AdsEcpm|AdsMetrics|AdsTracking", "ad"),
    (r"AdsManager|SponsoredPosts", "ad"),
    (r"UpdateUserLastActive|LastActiveMutation", "presence"),
    (r"PresencePing|UpdatePresence|HeartbeatMutation", "presence"),
    (r"UserSignals(?!Hovercard)", "presence"),
    (r"NotificationsUpdateSeenState|UpdateSeenState", "notif_seen"),
    (r"FriendsBadgeCountClear|BadgeCount.*Clear", "notif_seen"),
    (r"JewelUpdateSeen|JewelSeen", "notif_seen"),
    (r"NotificationMark.*Read|MarkNotification.*Read", "notif_seen"),
    (r"HovercardQueryRenderer|UserHovercard", "hover"),
    (r"UserSignalsHovercard", "hover"),
    (r"UFICommentsCountTooltip|UFIReactionsCountTooltip", "hover"),
    (r"Hovercard|Tooltip(?!Logger)", "hover"),
    (r"PreviewCard|LinkPreview", "hover"),
    (r"UFIFeedbackReact(?!ionsCount)", "react"),
    (r"UFIFeedbackLike", "react"),
    (r"UFIRemoveReact|UndoReaction|UnlikeMutation", "react"),
    (r"ReactionsMutation|ReactToStory", "react"),
    (r"LightspeedRequestSend|SendMessageMutation", "msg"),
    (r"Message.*Send|SendMessage|MessengerMessageSend", "msg"),
    (r"MessageRead|ReadThread|MarkThread.*Read|MarkRead", "msg"),
    (r"TypingIndicator|ThreadTyping|Message.*Typing", "msg"),
    (r"Message.*React|ReactToMessage", "msg"),
    (r"MessageDelete|UnsendMessage|DeleteMessage", "msg"),
    (r"EncryptedBackup|E2EE.*Backup|BackupIds", "msg"),
    (r"EBMessage|EncryptedMessage|EBSession", "msg"),
    (r"MAWVerifyThread|MAWSecureThread", "msg"),
    (r"MWChatTab|MWEncryptedBackups|MWQuickPromotion", "msg"),
    (r"MessagingJewel|CometMessagingJewel", "msg"),
    (r"LSPlatform|Lightspeed", "msg"),
    (r"MWAnimatedImage|ChatVideoAutoplay", "msg"),
    (r"MessengerConfig|MessengerSettings|OhaiWeb", "msg"),
    (r"MessengerThread|ThreadViewQuery|ThreadsList", "msg"),
    (r"InboxList|ThreadNavigation", "msg"),
    (r"BizInboxRTCCallButton|BusinessCall", "msg"),
    (r"BizInbox|BusinessMessag|BusinessCometBizSuite", "msg"),
    (r"RTWebCall|RTWebCallBlock", "msg"),
    (r"Messenger", "msg"),
    (r"NewsFeedPagination|FeedPaginat", "view"),
    (r"FeedRefetch|ModernHomeFeed|ModernFeed", "view"),
    (r"HomePageTimelineFeed|HomeRoot|CometModernHome", "view"),
    (r"FeedStory|FeedStories|StoryPager", "view"),
    (r"StoriesTrayRectangular|StoriesTray|StoriesRail", "view"),
    (r"StoryView|ViewStory|StoryBucket|StoryViewer", "view"),
    (r"WatchHome|WatchFeed|WatchRoot", "view"),
    (r"FBUnifiedVideoRootWithEntrypoint|FBUnifiedVideo", "view"),
    (r"VideoPlayer|VideoPlaying|UnifiedVideo", "view"),
    (r"fetchMWChatVideoAutoplay", "view"),
    (r"ProfileSwitchMutation|CometProfileSwitch", "nav"),
    (r"useProfileComet.*Update|ProfileUpdateMutation", "compose"),
    (r"ContextualProfile|CometContextualProfile", "view"),
    (r"CometProfileRoot|ProfileTimelineListView", "view"),
    (r"ProfileDirectory|ProfileSpecialties", "view"),
    (r"ProfileQuery", "view"),
    (r"FriendList|FriendingComet", "view"),
    (r"HomeContactsContainer|ContactsContainer", "view"),
    (r"RightSideEgo|HomeRightSideEgo", "view"),
    (r"CommentCreate|AddComment|PostComment", "compose"),
    (r"CommentEdit|EditComment|UpdateComment", "compose"),
    (r"CommentDelete|DeleteComment", "act"),
    (r"UnifiedShareSheet", "act"),
    (r"SharePostMutation|ShareAttachment", "act"),
    (r"Share(?!d|Sheet)", "act"),
    (r"FriendRequestSend|SendFriendRequest", "act"),
    (r"FriendRequestAccept|AcceptFriend", "act"),
    (r"Follow(?!ers)|SubscribeUser", "act"),
    (r"Unfollow|UnsubscribeUser", "act"),
    (r"GroupJoin|JoinGroup|RequestToJoin", "act"),
    (r"SavePost|SaveDashboard|BookmarkAdd", "act"),
    (r"HidePost|SnoozePost|Hide|Snooze", "act"),
    (r"ReportPost|FlagPost|Report(?!ing)", "act"),
    (r"PseudoBlockedUserInterstitial", "view"),
    (r"BlockUser|BlockMutation|Block(?!ed)", "act"),
    (r"MuteUser|Mute(?!d)", "act"),
    (r"ComposerUpload|UploadPhoto|UploadVideo|PhotoUpload", "compose"),
    (r"ComposerPublish|PublishPost|CreatePost|CreateStatus", "compose"),
    (r"StoriesComposer|CreateStory|StoryComposer", "compose"),
    (r"Composer", "compose"),
    (r"SearchResults|SearchQuery(?!Rendered)", "search"),
    (r"SearchBootstrap|SearchSuggestion|SearchTypeahead", "search"),
    (r"KeywordsDataSource|KeywordSearch", "search"),
    (r"MarketplaceSearch", "search"),
    (r"NotificationsDropdown|NotificationsList", "view"),
    (r"NotificationsQuery|NotificationFetch", "view"),
    (r"CrossGroupFeed|GroupsCometCrossGroup", "view"),
    (r"GroupsCometLeftRail|GroupsLeftNav", "nav"),
    (r"GroupsComet|CometGroup.*Feed|GroupFeed", "view"),
    (r"GroupRoot", "view"),
    (r"Marketplace.*Item|MarketplaceProduct|MarketplaceListing", "view"),
    (r"Marketplace", "view"),
    (r"SinglePostDialog|PostDialog|SinglePost", "view"),
    (r"PhotoRoot|PhotoViewer|PhotoRootContent", "view"),
    (r"PhotoTagLayer|TagPhoto", "view"),
    (r"SaveDashboard|SavedItems", "view"),
    (r"UFIComments(?!Count)|CommentsView|CommentsList", "view"),
    (r"BizKitLocalNavigation|BizKitBadging", "nav"),
    (r"BizInboxSuggestionBar", "msg"),
    (r"BusinessPage|BizPage", "view"),
    (r"BizKit|BusinessCometBizSuite", "nav"),
    (r"BulkRouteDefinitions|RouteDefinitions|RouteDefinition", "nav"),
    (r"RelayModern|RelayEf|RelayPrefetch|relay-ef", "nav"),
    (r"RightSideHeaderCards|RightSideHeader", "nav"),
    (r"NavBar|SideBar", "nav"),
    (r"WebStorage|LocalStorage|SessionStorage", "nav"),
    (r"ExposeGating|Gating|FeatureFlag", "nav"),
    (r"UserPreferences", "nav"),
    (r"Subscription$|LiveSubscription", "nav"),
    (r"Settings", "nav"),
    (r"Logout", "act"),
    (r"Root.*Query$|PageQuery$", "nav"),
]

#: What a name of no rule hints at, in order of priority.
HINTS: list[tuple[str, str]] = [
    (r"Hover|Tooltip|Preview", "hover"),
    (r"AdsHalo|InstreamAd|Sponsored", "ad"),
    (r"PresencePing|LastActive|Heartbeat", "presence"),
    (r"ScreenTime|TimeLimit|ProductUsage", "self_surv"),
    (r"SeenState|BadgeClear|MarkSeen", "notif_seen"),
    (r"Send.*Message|MessageSend|LS.*Send", "msg"),
    (r"Message|Thread|Messenger|Chat", "msg"),
    (r"FeedPagination|NewsFeed|HomeFeed", "view"),
    (r"Profile|Friends|Contacts|People", "view"),
    (r"Group", "view"),
    (r"Photo|Video|Watch|Story", "view"),
    (r"Comment.*Create|Post.*Create|Compose", "compose"),
    (r"UFIFeedback|React(?!ions)", "react"),
    (r"Search", "search"),
    (r"Block|Mute|Hide|Report|Snooze", "act"),
    (r"Save|Bookmark", "act"),
    (r"Share", "act"),
    (r"Route.*Def|Nav|Sidebar|Header", "nav"),
    (r"Setting|Config|Preferences|Gating", "nav"),
    (r"Relay|Subscription|Prefetch", "nav"),
]

#: Rule ids of the fallbacks, below the rules' own numbers.
UNKNOWN, MUTATION, QUERY, BY_PATH, BY_ROUTE = -1, -2, -3, -4, -5

Rules = list[tuple[str, str]]


def decoder(rules: Rules = RULES) -> Callable[[str], tuple[int, str]]:
    """A function from a non-empty name to (rule number, category)."""
    compiled = [(re.compile(p, re.I), c) for p, c in rules]

    def decode(name: str) -> tuple[int, str]:
        for i, (rx, category) in enumerate(compiled):
            if rx.search(name):
                return i, category
        if name.endswith("Mutation"):
            return MUTATION, "act"
        if name.endswith("Query"):
            return QUERY, "view"
        return UNKNOWN, "nav"

    return decode


def by_name(name: Column | str, rules: Rules = RULES, remembered: int = 200_000) -> Column:
    """A struct (rule_id, category) for a name; null for null and empty names.

    Names repeat heavily, so each task decodes a name once and remembers it: no join back, which a
    name with a third of all rows would skew, and no chain of a hundred patterns per row.
    """

    @F.pandas_udf("rule_id int, category string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decode, known = decoder(rules), {}
        for names in batches:
            for n in names.dropna().unique():
                if n and n not in known:
                    if len(known) >= remembered:
                        known.clear()
                    known[n] = decode(n)
            yield pd.DataFrame([known.get(n) or (decode(n) if n else (None, None)) for n in names], columns=["rule_id", "category"])

    return decoded(F.col(name) if isinstance(name, str) else name)


def by_path(path: Column) -> Column:
    """The category of a request without a name, by its path; null where the path says nothing."""
    has = lambda *parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(path, p))
    return F.when(has("route-definition", "bulk-route"), "nav").when(has("unified_cvc"), "presence").when(has("webstorage", "navigation", "gating", "user_preferences", "graphql"), "nav")


def decoded_category(name: Column, path: Column, route: Column, rules: Rules = RULES) -> Column:
    """A struct (rule_id, category): by name, else by path, else a view of the route."""
    d = by_name(name, rules)
    p = by_path(path)
    rest = F.when(p.isNotNull(), F.struct(F.lit(BY_PATH).alias("rule_id"), p.alias("category"))).when(F.coalesce(route, F.lit("")) == "", F.struct(F.lit(UNKNOWN).alias("rule_id"), F.lit("nav").alias("category")))
    rest = F.coalesce(rest, F.struct(F.lit(BY_ROUTE).alias("rule_id"), F.lit("view").alias("category")))
    return F.when(F.coalesce(name, F.lit("")) != "", F.struct(d["rule_id"].alias("rule_id"), d["category"].alias("category"))).otherwise(rest)


def unreachable(rules: Rules = RULES) -> list[tuple[int, int]]:
    """(rule, earlier rule) where each plain alternative of a rule already matches an earlier rule."""
    compiled = [re.compile(p, re.I) for p, _ in rules]
    out = []
    for i, (pattern, _) in enumerate(rules):
        words = pattern.split("|")
        if any(re.search(r"[.*$(\[]", w) for w in words):
            continue
        caught = [next((j for j in range(i) if compiled[j].search(w)), None) for w in words]
        if None not in caught:
            out.append((i, max(caught)))
    return out
