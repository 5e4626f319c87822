"""Every threshold, weight and constant; queries take them as parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass

TCP, UDP = 6, 17
DNS_PORT, HTTPS_PORT, MODBUS_PORT = 53, 443, 502
EPHEMERAL_MIN = 1024
NXDOMAIN = 3
TXT_LIKE = (10, 16)
#: UDP services that are abused for amplification.
AMPLIFIERS = (19, 53, 123, 161, 389, 1900, 11211)
#: Public suffixes of two labels.
TWO_LABEL_SUFFIXES = tuple(
    "co.uk org.uk ac.uk gov.uk co.in net.in org.in gov.in ac.in nic.in res.in com.au net.au co.jp com.cn com.br co.za".split()
)
INTERNAL_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
STEEPNESS = 4.0
MIN_CONFIDENCE = 0.5

#: Impact of each threat class on severity.
IMPACT = {
    "ddos": 1.0,
    "c2_beacon": 0.9,
    "dga": 0.85,
    "dns_tunnel": 0.9,
    "encrypted_malware": 0.95,
    "recon_scan": 0.7,
    "exfiltration": 1.0,
    "campaign": 1.0,
}


@dataclass(frozen=True)
class Baseline:
    alpha: float = 0.1
    ready: int = 5
    std_floor: float = 0.1


@dataclass(frozen=True)
class Ddos:
    window_s: float = 5.0
    flows_per_s: float = 500.0
    amp_bytes_per_s: float = 1_250_000.0
    rate_z: float = 6.0
    entropy_bits: float = 10.0
    syn_only: float = 0.8
    amp_ratio: float = 10.0
    w_rate: float = 0.35
    w_entropy: float = 0.25
    w_syn: float = 0.25
    w_amp: float = 0.15
    min_confidence: float = MIN_CONFIDENCE
    baseline: Baseline = Baseline()


@dataclass(frozen=True)
class Trw:
    benign: float = 0.8
    scanner: float = 0.2
    alpha: float = 0.01
    beta: float = 0.99

    @property
    def on_success(self) -> float:
        return math.log(self.scanner / self.benign)

    @property
    def on_failure(self) -> float:
        return math.log((1 - self.scanner) / (1 - self.benign))

    @property
    def upper(self) -> float:
        return math.log(self.beta / self.alpha)

    @property
    def lower(self) -> float:
        return math.log((1 - self.beta) / (1 - self.alpha))


@dataclass(frozen=True)
class Scan:
    gap_s: float = 60.0
    targets: int = 20
    failed: float = 0.5
    shape: float = 5.0
    w_trw: float = 0.4
    w_targets: float = 0.35
    w_failed: float = 0.25
    min_confidence: float = MIN_CONFIDENCE
    trw: Trw = Trw()


@dataclass(frozen=True)
class Beacon:
    connections: int = 6
    history: int = 64
    min_interval_s: float = 5.0
    interval_cv: float = 0.2
    bytes_cv: float = 0.5
    shared_hosts: int = 3
    w_interval: float = 0.45
    w_size: float = 0.25
    w_repeat: float = 0.2
    w_prevalence: float = 0.1
    min_confidence: float = MIN_CONFIDENCE


@dataclass(frozen=True)
class Lexical:
    min_label: int = 8
    entropy_bits: float = 3.3
    rare_bigrams: float = 0.5
    digits: float = 0.2
    long_label: int = 12
    w_entropy: float = 0.35
    w_bigrams: float = 0.35
    w_digits: float = 0.15
    w_length: float = 0.15


@dataclass(frozen=True)
class Dga:
    window_s: float = 60.0
    name_score: float = 0.6
    names: int = 20
    nxdomain: float = 0.5
    w_names: float = 0.35
    w_nxdomain: float = 0.35
    w_score: float = 0.3
    samples: int = 5
    min_confidence: float = MIN_CONFIDENCE


@dataclass(frozen=True)
class Tunnel:
    window_s: float = 300.0
    subdomains: int = 100
    label_len: float = 40.0
    txt: float = 0.5
    w_subdomains: float = 0.35
    w_label: float = 0.35
    w_txt: float = 0.3
    min_confidence: float = MIN_CONFIDENCE


@dataclass(frozen=True)
class Tls:
    warmup: int = 200
    rare_hosts: int = 1
    min_confidence: float = 0.6
    w_blocklist: float = 0.5
    w_rarity: float = 0.3
    w_sni: float = 0.2
    present: float = 0.5


@dataclass(frozen=True)
class Exfil:
    window_s: float = 60.0
    bytes_out: float = 50.0 * 1024 * 1024
    pcr: float = 0.8
    zscore: float = 4.0
    w_volume: float = 0.35
    w_pcr: float = 0.35
    w_zscore: float = 0.3
    min_confidence: float = MIN_CONFIDENCE
    baseline: Baseline = Baseline()


@dataclass(frozen=True)
class Fusion:
    dedup_s: float = 300.0
    correlation_s: float = 900.0
    min_stages: int = 2
    confidence: float = 0.9
    stage_bonus: float = 0.03
    max_confidence: float = 0.99
    top_factors: int = 5
    weight_base: float = 0.6
    weight_step: float = 0.1
    criticality: int = 3
    critical: int = 80
    high: int = 60
    medium: int = 40


@dataclass(frozen=True)
class FlowMeter:
    active_s: float = 5.0
    idle_s: float = 15.0
    short_idle_s: float = 2.0
    sweep_s: float = 1.0
    splt: int = 20


@dataclass(frozen=True)
class Ml:
    min_confidence: float = 0.6
    dga_min_confidence: float = 0.9
    epsilon_s: float = 1e-3
    benign: str = "benign"


#: Kill-chain order and wording of the classes that make up a campaign.
STAGES = (
    ("recon_scan", "reconnaissance"),
    ("dga", "DGA lookups"),
    ("encrypted_malware", "malicious TLS"),
    ("c2_beacon", "C2 beaconing"),
    ("dns_tunnel", "DNS tunnelling"),
    ("exfiltration", "exfiltration"),
)
