"""Page chrome of five known sites. Another site is added by passing a longer dict."""

# --- fixed values: whole lines, same-site link words, line patterns and section heads per site ----
_SIDEBAR_BODY = r"(?:[-*+]\s+)?!?\[.*|\S+(?: \S+){0,3}"

SITE_RULES = {
    "github": {
        "domains": ["github.com"],
        "signature": r"© \d{4} GitHub, Inc\.",
        "plain": [
            "skip to content", "sign in", "sign up", "navigation menu", "search or jump to", "saved searches",
            "use saved searches to filter your results more quickly", "appearance settings", "dismiss alert", "footer",
            "footer navigation", "you can't perform that action at this time",
            "you signed in with another tab or window. reload to refresh your session",
            "you signed out in another tab or window. reload to refresh your session",
            "you switched accounts on another tab or window. reload to refresh your session", "no releases published",
            "no packages published", "create a new release", "publish your first package", "report repository",
            "sign up for free to join this conversation on github", "already have an account? sign in to comment",
            "you're not receiving notifications from this thread", "there was an error while loading. please reload this page",
        ],
        "link_words": [
            "product", "solutions", "resources", "open source", "enterprise", "pricing", "code", "issues", "pull requests", "actions",
            "projects", "security", "insights", "wiki", "go to file", "add file", "fork", "star", "watch", "terms", "privacy", "status",
            "docs", "contact", "manage cookies", "do not share my personal information", "new issue", "notifications", "sponsor",
            "github sponsors", "community", "training",
        ],
        "heads": ["navigation menu", "footer", "footer navigation"],
        "lines": [
            r"© \d{4} github, inc",
            r"[\d.,]+k? (stars?|watching|forks?|watchers)",
            r"\+ ?\d+ (contributors?|releases|languages)",
            r"(activity|custom properties)",
            r"sign up for free to join this conversation on github\.? already have an account\? sign in to comment",
        ],
        "blocks": [
            (r"languages", r"[\w#+.\- ]+ \d+(?:\.\d+)?%"),
            (r"(releases|contributors|packages|used by|deployments|environments)\s+[\d.,]+k?", _SIDEBAR_BODY),
            (
                r"assignees|labels|projects|milestone|development|notifications|participants",
                r"no one assigned|none yet|no milestone|no branches or pull requests|customize"
                r"|subscribe|unsubscribe|you're not receiving notifications from this thread\.?",
            ),
        ],
    },
    "linkedin": {
        "domains": ["linkedin.com"],
        "signature": r"linkedin corporation ©|agree & join linkedin",
        "plain": [
            "skip to main content", "sign in", "join now", "sign in to view more content", "join now to see what you are missing",
            "new to linkedin? join now", "agree & join linkedin", "continue to join or sign in",
            "by clicking continue to join or sign in, you agree to linkedin's user agreement, privacy policy, and cookie policy",
            "report this post", "add a comment", "see more comments", "sign in to view more comments",
        ],
        "link_words": [
            "like", "comment", "share", "repost", "send", "about", "accessibility", "user agreement", "privacy policy", "cookie policy",
            "copyright policy", "brand policy", "guest controls", "community guidelines", "sign in", "join now", "forgot password?",
            "help center",
        ],
        "heads": [],
        "lines": [
            r"(like|comment|repost|share|send)(?: (?:like|comment|repost|share|send))+",
            r"[\d.,]+k? (reactions?|comments?|reposts?)",
            r"linkedin( corporation)? © \d{4}",
        ],
        "blocks": [
            (r"people also viewed|others also viewed|similar pages|explore topics", None),
            (r"more (articles|posts) by .*|insights from the community", None),
        ],
    },
    "x": {
        "domains": ["x.com", "twitter.com"],
        "signature": r"don'?t miss what'?s happening",
        "plain": [
            "don't miss what's happening", "people on x are the first to know", "new to x?",
            "sign up now to get your own personalized timeline", "something went wrong. try reloading", "log in", "sign up",
            "create account", "sign up with google", "sign up with apple", "see new posts", "post your reply",
        ],
        "link_words": [
            "home", "explore", "notifications", "messages", "grok", "bookmarks", "communities", "premium", "profile", "more", "post",
            "lists", "jobs", "privacy policy", "cookie policy", "accessibility", "ads info", "terms of service", "help center", "log in",
            "sign up",
        ],
        "heads": [],
        "lines": [
            r"terms of service\s*\|.*",
            r"© \d{4} x corp",
            r"read \d+ repl(?:y|ies)",
            r"(?:[\d.,]+[km]? (?:views?|replies|reposts?|likes?|bookmarks?|quotes?)\s*)+",
            r"\d{1,2}:\d{2} (?:am|pm) · .*· [\d.,]+[km]? views?",
        ],
        "blocks": [(r"relevant people|trending now|what's happening", None)],
    },
    "reddit": {
        "domains": ["reddit.com", "redd.it"],
        "signature": r"reddit, inc\. ©",
        "plain": [
            "skip to main content", "open menu", "open navigation", "go to reddit home", "log in", "sign up", "log in / sign up",
            "get app", "get the reddit app", "expand user menu", "open settings menu", "open comment sort options", "add a comment",
            "join the conversation", "continue this thread", "load more comments", "give award",
        ],
        "link_words": [
            "share", "reply", "award", "save", "report", "follow", "join", "home", "popular", "all", "explore", "communities",
            "reddit rules", "privacy policy", "user agreement",
        ],
        "heads": [],
        "lines": [
            r"sort by:? \w+",
            r"\d+ more repl(?:y|ies)",
            r"[\d.,]+k? (?:comments?|upvotes?|points?)",
            r"reddit,? inc\.? © \d{4}.*",
            r"reddit rules.*user agreement.*",
        ],
        "blocks": [(r"related answers|more posts you may like|top posts|related posts", None)],
    },
    "youtube": {
        "domains": ["youtube.com", "youtu.be"],
        "signature": r"skip navigation",
        "plain": [
            "skip navigation", "sign in", "sign in to confirm you're not a bot", "subscribe", "subscribed", "share", "save", "download",
            "clip", "show more", "show less", "add a comment", "up next", "autoplay", "show chat replay",
        ],
        "link_words": [],
        "heads": [],
        "lines": [r"[\d.,]+[kmb]? (?:views|subscribers|likes)"],
        "blocks": [(r"up next|comments?(?:\s+[\d.,]+[km]?)?|recommended", None)],
    },
}
