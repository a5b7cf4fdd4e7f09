"""What each vendor's wording means as a verdict."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verdicts and their order, and each vendor's words for them.
RANK = {"blocked": 5, "rate_limited": 4, "challenged": 3, "monitored": 2, "allowed": 1, "unknown": 0}
CLOUDFLARE = {
    "block": "blocked",
    "drop": "blocked",
    "challenge": "challenged",
    "jschallenge": "challenged",
    "interactivechallenge": "challenged",
    "managedchallenge": "challenged",
    "managedchallengeinteractivesolved": "challenged",
    "managedchallengenoninteractivesolved": "challenged",
    "managedchallengebypassed": "challenged",
    "connectionclose": "rate_limited",
    "ratelimit": "rate_limited",
    "log": "monitored",
    "simulate": "monitored",
    "allow": "allowed",
    "skip": "allowed",
    "bypass": "allowed",
    "unknown": "allowed",
    "": "allowed",
}
F5 = {"blocked": "blocked", "passed": "allowed", "alerted": "monitored"}
F5_RATE_WORDS = "rate limit|brute force|anomaly|flood|dos"
DATADOME = {
    "block": "blocked",
    "hardblock": "blocked",
    "captcha": "challenged",
    "devicecheck": "challenged",
    "challenge": "challenged",
    "ratelimit": "rate_limited",
    "allow": "allowed",
    "pass": "allowed",
    "monitor": "monitored",
    "protect": "monitored",
}


def _looked_up(word: Column, meanings: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for x in chain.from_iterable(meanings.items())))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(F.coalesce(word, F.lit(""))))), F.lit("unknown"))


def rank(verdict: Column) -> Column:
    """How restrictive a verdict is."""
    order = F.create_map(*(F.lit(x) for x in chain.from_iterable(RANK.items())))
    return F.coalesce(F.try_element_at(order, verdict), F.lit(0))


def cloudflare_verdict(action: Column) -> Column:
    return _looked_up(action, CLOUDFLARE)


def f5_verdict(status: Column, violations: Column, attack_type: Column, sub_violations: Column) -> Column:
    """A block for too many requests is a rate limit."""
    verdict = _looked_up(status, F5)
    reason = F.lower(F.concat_ws(" ", violations, attack_type, sub_violations))
    return F.when((verdict == "blocked") & reason.rlike(F5_RATE_WORDS), "rate_limited").otherwise(verdict)


def datadome_verdict(action: Column, is_bot: Column) -> Column:
    """Without an action a bot was only watched."""
    empty = F.trim(F.coalesce(action, F.lit(""))) == ""
    return F.when(empty, F.when(F.coalesce(is_bot, F.lit(False)), "monitored").otherwise("allowed")).otherwise(_looked_up(action, DATADOME))


def datadome_call_verdict(status: Column, response_type: Column) -> Column:
    """Verdict of a call to the bot service that the edge has logged."""
    kind = F.lower(F.coalesce(response_type, F.lit("")))
    return (
        F.when(status == 200, F.when(kind.isin("interstitial", "block", "hard_block"), "monitored").otherwise("allowed"))
        .when(status == 403, F.when(kind == "hard_block", "blocked").otherwise("challenged"))
        .otherwise("unknown")
    )


def nginx_verdict(upstream: Column, status: Column) -> Column:
    """What reached an upstream was allowed."""
    reached = ~F.trim(F.coalesce(upstream, F.lit(""))).isin("", "-")
    return F.when(reached, "allowed").when(status == 403, "blocked").when(status == 429, "rate_limited").otherwise("allowed")
