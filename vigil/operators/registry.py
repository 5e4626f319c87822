"""The detectors, what they read, and which of them an input allows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from vigil.lineage import cut
from vigil.operators.beacon import beacons
from vigil.operators.ddos import ddos
from vigil.operators.dns import generated_names, tunnels
from vigil.operators.exfil import uploads
from vigil.operators.ml import classify_flows, classify_queries
from vigil.operators.scan import scans
from vigil.operators.tls import tls_clients
from vigil.params import INTERNAL_NETWORKS
from vigil.operators.base import together
from vigil.sources.readers import Intel


@dataclass
class Context:
    networks: tuple[str, ...] = INTERNAL_NETWORKS
    intel: Intel | None = None
    flow_model: object | None = None
    dns_model: object | None = None


@dataclass(frozen=True)
class Detector:
    name: str
    consumes: str
    purpose: str
    batch: Callable[[DataFrame, Context], DataFrame]
    needs: str | None = None

    def unavailable(self, kinds: set[str], context: Context) -> str | None:
        """Why the detector can't run, or None."""
        if self.consumes not in kinds:
            return f"the input has no {self.consumes} events"
        if self.needs and getattr(context, self.needs) is None:
            return "no model is given"
        return None


DETECTORS = (
    Detector("ddos-stat", "flows", "floods and amplification", lambda e, c: ddos(e)),
    Detector("scan-trw", "flows", "port scans and host sweeps", lambda e, c: scans(e)),
    Detector("beacon-score", "flows", "periodic check-ins", lambda e, c: beacons(e)),
    Detector("exfil-baseline", "flows", "lopsided uploads", lambda e, c: uploads(e, networks=c.networks)),
    Detector("dns-dga", "dns", "generated domain names", lambda e, c: generated_names(e)),
    Detector("dns-tunnel", "dns", "tunnelling in lookups", lambda e, c: tunnels(e)),
    Detector("tls-meta", "tls", "bad TLS clients", lambda e, c: tls_clients(e, c.intel.ja3 if c.intel else set(), c.intel.ja4 if c.intel else set())),
    Detector("ml-flow", "flows", "supervised flow classes", lambda e, c: classify_flows(e, c.flow_model, c.networks), "flow_model"),
    Detector("dga-ml", "dns", "supervised query classes", lambda e, c: classify_queries(e, c.dns_model), "dns_model"),
)


def available(kinds: set[str], context: Context) -> tuple[list[Detector], list[tuple[str, str]]]:
    """Detectors that can run, and (name, reason) of the others."""
    reasons = [(d, d.unavailable(kinds, context)) for d in DETECTORS]
    return [d for d, r in reasons if r is None], [(d.name, r) for d, r in reasons if r]


def detect(events: dict[str, DataFrame], context: Context | None = None) -> DataFrame:
    """Detections of every detector that the events allow.

    Detections are few beside events, so each detector's are written to the shared folder once: what fuses
    them reads them several times, and a plan of all detectors together would be large.
    """
    context = context or Context()
    ready, _ = available(set(events), context)
    return together([cut(d.batch(events[d.consumes], context)) for d in ready])
