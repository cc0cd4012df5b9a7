"""Default configuration."""

from __future__ import annotations

# Fixed values (must match for right results): the default phrase groups, in priority order.
DEFAULT_PHRASE_GROUPS = [
    {
        "id": "sponsor-start",
        "kind": "ad-read-start",
        "confidence": 0.85,
        "reason_label": "Transcript sponsor start cue",
        "phrases": [
            "today's sponsor",
            "todays sponsor",
            "sponsored by",
            "sponsor of this video",
            "sponsor of today's video",
            "sponsor of todays video",
            "thanks to our sponsor",
            "thanks to sponsor",
            "our sponsor",
            "made possible by",
            "this video is made possible by",
            "this episode is made possible by",
            "brought to you by",
            "presented by",
            "partnered with",
            "in partnership with",
            "a quick word from",
            "quick word from",
            "support for this channel comes from",
        ],
    },
    {
        "id": "ad-read-presence",
        "kind": "ad-read-presence",
        "confidence": 0.5,
        "reason_label": "Transcript ad-read call-to-action cue",
        "phrases": [
            "use code",
            "promo code",
            "discount code",
            "coupon code",
            "offer code",
            "link in the description",
            "click the link",
            "check out",
            "limited time",
            "free trial",
            "sign up",
            "head to",
            "go to",
            "visit",
            "sponsor",
            "sponsorship",
        ],
    },
    {
        "id": "return-to-content",
        "kind": "ad-read-end",
        "confidence": 0.7,
        "reason_label": "Transcript return-to-content cue",
        "phrases": [
            "now back to",
            "back to the video",
            "with that out of the way",
            "anyway",
            "let's get back",
            "lets get back",
            "back into",
            "now lets get back",
            "now let's get back",
        ],
    },
]

# Phrases counted as candidate features.
SPONSOR_FEATURE_PHRASES = [
    "sponsored by",
    "made possible by",
    "brought to you by",
    "presented by",
    "thanks to our sponsor",
    "support for this channel",
    "partnered with",
    "in partnership with",
]
CALL_TO_ACTION_FEATURE_PHRASES = [
    "use code",
    "promo code",
    "discount code",
    "coupon code",
    "offer code",
    "link in the description",
    "click the link",
    "check out",
    "free trial",
    "sign up",
    "head to",
    "go to",
    "visit",
]
