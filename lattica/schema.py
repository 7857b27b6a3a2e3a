"""Long-form tables of the engine. Rows of weight zero are absent; measurement 0 is a missed detection."""

REWARD = "frame long, track int, meas int, ll double"
HYPOTHESIS = "frame long, cluster int, hypo int, tracks array<int>, prob double"
CLUSTER_MAP = "frame long, cluster int, master int, is_master boolean"
MARGINAL = "frame long, track int, kind string, meas int, p double"
