"""Properties of the metrics and of linkage, over generated cases."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cloneframe.functions import metrics as M
from cloneframe.operators import cluster

residues = st.text("ACDEFGHIKLMNPQRSTVWY.", max_size=18)
metrics = st.sampled_from([M.Tcr(), M.Tcr(0, 0, True), M.Tcr(2, 1, False, 6), M.Edit(), M.Aligned(), M.Aligned(False)])


@settings(max_examples=60, deadline=None)
@given(metrics, residues, residues)
def test_symmetric_and_zero_on_itself(metric, a, b):
    d = metric.block([a, b], [a, b])
    assert d[0, 1] == d[1, 0] and d[0, 0] == 0 == d[1, 1] and d[0, 1] >= 0


@settings(max_examples=60, deadline=None)
@given(residues, residues)
def test_length_bound(a, b):
    """The bound that blocks use: each letter of length difference costs its penalty at least."""
    for metric in (M.Tcr(), M.Tcr(0, 0, True), M.Edit(), M.Aligned()):
        assert metric.block([a], [b])[0, 0] >= abs(len(a) - len(b)) * metric.length_cost()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 100), min_size=2, max_size=14), st.floats(0, 60))
def test_complete_linkage_keeps_the_cut(points, t):
    x = np.array(points)
    d = abs(x[:, None] - x)
    z = cluster.linkage(d)
    labels = cluster.cut_tree(z, len(x), t)
    assert (np.diff(z[:, 2]) >= -1e-9).all() and z[-1, 3] == len(x)
    for k in set(labels):
        assert d[np.ix_(labels == k, labels == k)].max() <= t + 1e-9
