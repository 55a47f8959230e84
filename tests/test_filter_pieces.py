"""Multi-frame filters in pieces of rows with equally many bins."""

import numpy as np

from waveloom._np import quality as Q
from waveloom.operators import quality


def test_pieces_of_unequal_bins(spark):
    r, rows, want = np.random.default_rng(1), [], {}
    for t in range(700):
        bins = 3 + t // 300
        z = r.standard_normal((2, 2, bins, 2, 2)) @ np.array([1, 1j])
        ss, nn = np.einsum("kxbi,kxbj->kbij", z, z.conj())
        want[t] = Q.mvdr_weights(ss[:, :, -1] / (ss[:, -1:, -1] + 1e-10), ss + Q.loaded(nn)).T
        m = lambda x: x.transpose(1, 2, 0).tolist()
        rows.append((1, 0, t, m(ss.real), m(ss.imag), m(nn.real), m(nn.imag)))
    kind = "array<array<array<double>>>"
    df = spark.createDataFrame(rows, f"clip_id long, ch int, t long, rss_re {kind}, rss_im {kind}, rnn_re {kind}, rnn_im {kind}").coalesce(1)
    got = {x.t: np.array(x.w_re) + 1j * np.array(x.w_im) for x in quality.multiframe_filter(df, 2).collect()}
    assert quality.PIECE < 300 and got.keys() == want.keys() and all(np.allclose(got[t], w) for t, w in want.items())
