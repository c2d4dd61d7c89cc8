"""User agents: bot test (F1) and operating system, browser, device."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

_BOT = "(?i)" + "|".join(re.escape(word).replace("/", r"\/") for word in rules.BOT_WORDS)

# First match wins. A rule holds if all its texts occur in the lower-case agent;
# a text starting with "!" must not occur.
SYSTEM_RULES = [
    ("windows phone", ["windows phone"]),
    ("windows", ["windows"]),
    ("ios", ["iphone"]),
    ("ios", ["ipad"]),
    ("ios", ["ipod"]),
    ("ios", ["cfnetwork/", "darwin"]),
    ("harmonyos", ["harmonyos"]),
    ("android", ["android"]),
    ("tizen", ["tizen"]),
    ("webos", ["webos"]),
    ("webos", ["web0s"]),
    ("kaios", ["kaios"]),
    ("blackberry", ["blackberry"]),
    ("blackberry", ["bb10"]),
    ("chromecast", ["crkey"]),
    ("chromium os", ["cros "]),
    ("macos", ["mac os x"]),
    ("macos", ["macintosh"]),
    ("playstation", ["playstation"]),
    ("xbox", ["xbox"]),
    ("ubuntu", ["ubuntu"]),
    ("fedora", ["fedora"]),
    ("debian", ["debian"]),
    ("freebsd", ["freebsd"]),
    ("openbsd", ["openbsd"]),
    ("linux", ["linux"]),
]

BROWSER_RULES = [
    ("edge", ["edg/"]),
    ("edge", ["edge/"]),
    ("edge", ["edga/"]),
    ("edge", ["edgios/"]),
    ("opera mini", ["opera mini"]),
    ("opera gx", ["oprgx/"]),
    ("opera touch", ["opt/"]),
    ("opera", ["opr/"]),
    ("opera", ["opera"]),
    ("samsung internet", ["samsungbrowser/"]),
    ("yandex", ["yabrowser/"]),
    ("vivaldi", ["vivaldi/"]),
    ("duckduckgo", ["duckduckgo/"]),
    ("duckduckgo", ["ddg/"]),
    ("ucbrowser", ["ucbrowser/"]),
    ("miui browser", ["miuibrowser/"]),
    ("huawei browser", ["huaweibrowser/"]),
    ("silk", ["silk/"]),
    ("wechat", ["micromessenger/"]),
    ("facebook", ["fban/"]),
    ("facebook", ["fbav/"]),
    ("instagram", ["instagram"]),
    ("snapchat", ["snapchat"]),
    ("linkedin", ["linkedinapp"]),
    ("gsa", ["gsa/"]),
    ("firefox focus", ["focus/"]),
    ("firefox", ["fxios/"]),
    ("chrome", ["crios/"]),
    ("chrome headless", ["headlesschrome"]),
    ("electron", ["electron/"]),
    ("firefox", ["firefox/", "!seamonkey/"]),
    ("chrome webview", ["; wv)", "chrome/"]),
    ("chrome", ["chrome/"]),
    ("android browser", ["android", "version/", "safari/"]),
    ("safari", ["version/", "safari/"]),
    ("safari", ["webkit", "safari/"]),
    ("ie", ["msie "]),
    ("ie", ["trident/", "rv:"]),
]


def is_bot(agent: Column) -> Column:
    """known bot words; a missing or empty agent is not a bot."""
    return F.coalesce(agent.rlike(_BOT), F.lit(False))


def _holds(lowered: Column, texts: list[str]) -> Column:
    tests = [
        ~lowered.contains(text[1:]) if text.startswith("!") else lowered.contains(text)
        for text in texts
    ]
    return reduce(lambda a, b: a & b, tests)


def _first_rule(lowered: Column, table: list[tuple[str, list[str]]]) -> Column:
    chosen = F
    for name, texts in table:
        chosen = chosen.when(_holds(lowered, texts), name)
    return chosen.otherwise("unknown")


def system_of(lowered: Column) -> Column:
    return _first_rule(lowered, SYSTEM_RULES)


def browser_of(lowered: Column) -> Column:
    return _first_rule(lowered, BROWSER_RULES)


def device_of(bot: Column, system: Column) -> Column:
    """Device class; bots first, whatever system they claim."""
    return (
        F.when(bot, "bot")
        .when(system == "ios", "mobile-ios")
        .when(system == "android", "mobile-android")
        .when(system.isin(*rules.DESKTOP_SYSTEMS), "desktop")
        .otherwise("unknown")
    )
