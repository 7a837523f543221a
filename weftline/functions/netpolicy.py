"""Network policy: which addresses and URLs may be fetched."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def address_allowed(address: str | None, allow: tuple[str, ...] = ()) -> bool | None:
    """Whether an address is a globally routable unicast one or in an allowed network; mapped IPv6 counts as its IPv4. Null for no address."""
    if address is None:
        return None
    try:
        ip = ipaddress.ip_address(address.strip().strip("[]"))
    except ValueError:
        return None
    ip = getattr(ip, "ipv4_mapped", None) or ip
    if any(ip.version == n.version and ip in n for n in map(ipaddress.ip_network, allow)):
        return True
    return ip.is_global and not ip.is_multicast


def allowed_udf(allow: tuple[str, ...] = ()) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def allowed(address: pd.Series) -> pd.Series:
        return address.map(lambda a: address_allowed(a, allow)).astype(object)

    return allowed


def host_allowed(host: Column, patterns: tuple[str, ...]) -> Column:
    """Exact host or ``*.suffix``, which also matches the bare domain."""
    out = F.lit(False)
    for p in patterns:
        p = p.lower()
        out = out | ((F.lower(host) == p[2:]) | F.lower(host).endswith(p[1:]) if p.startswith("*.") else F.lower(host) == p)
    return out
