import numpy as np

from voxelloom.operators import kernels as K


def test_gaussian_keeps_sum_and_constant():
    flat = np.full((9, 9), 3.0)
    assert np.allclose(K.gaussian(flat, 1.5), 3.0)
    assert abs(K.gaussian_kernel(2.0).sum() - 1) < 1e-12
    assert abs(K.second_derivative_kernel(1.0).sum() - 1) < 1e-9


def test_octant_is_not_centred():
    e = K.octant_element(3)
    assert e.shape == (3, 3, 3) and e[0, 0, 0] == 1 and e[2, 2, 2] == 0


def test_blobs_find_planted_spots():
    y, x = np.indices((40, 40))
    image = sum(np.exp(-((y - a) ** 2 + (x - b) ** 2) / (2 * 2.0**2)) for a, b in ((10, 12), (28, 30)))
    found = K.blobs(image, 1.0, 4.0, 1.2, 0.05, 0.5, 3)
    assert {(int(r[0]), int(r[1])) for r in found} == {(10, 12), (28, 30)}


def test_keep_apart_prefers_bright_points():
    points = np.array([[0, 0, 0, 1.0], [0, 0, 1, 1.0], [0, 0, 9, 1.0]])
    assert K.keep_apart(points, np.array([1.0, 5.0, 2.0]), 3.0).tolist() == [1, 2]
    assert K.keep_apart(points, np.array([1.0, 5.0, 2.0]), 0.0).tolist() == [0, 1, 2]


def test_affine_identity_and_shift():
    block = np.arange(24.0).reshape(2, 3, 4)
    assert np.allclose(K.affine_resample(block, np.eye(3), np.zeros(3), block.shape), block)
    moved = K.affine_resample(block, np.eye(3), np.array([0, 1, 0]), block.shape, fill=-1)
    assert np.allclose(moved[:, :2], block[:, 1:]) and (moved[:, 2] == -1).all()
    half = K.affine_resample(block, np.eye(3), np.array([0, 0, 0.5]), block.shape, renormalize=True)
    assert np.allclose(half[..., 3], block[..., 3])


def test_phase_shift_recovers_translation():
    rng = np.random.default_rng(0)
    fixed = K.gaussian(rng.random((12, 16, 20)), 1.0)
    moving = np.roll(fixed, (2, -3, 4), (0, 1, 2))
    assert np.allclose(K.phase_shift(fixed, moving, 10), (-2, 3, -4), atol=0.11)


def test_content_weights_bounds():
    assert (K.content_weights(np.ones((4, 4, 4))) == 1).all()
    w = K.content_weights(np.random.default_rng(1).random((6, 6, 6)))
    assert w.min() >= 0.25 and w.max() <= 1.5


def test_richardson_lucy_sharpens():
    truth = np.zeros((1, 17, 17))
    truth[0, 8, 8] = 100
    psf = np.exp(-((np.indices((1, 5, 5))[1] - 2) ** 2 + (np.indices((1, 5, 5))[2] - 2) ** 2) / 2)
    pad = np.zeros(truth.shape)
    pad[0, 6:11, 6:11] = psf / psf.sum() * 100
    assert K.richardson_lucy(pad, psf, 20)[0, 8, 8] > pad[0, 8, 8] * 1.5


def test_profile_fit_and_labels():
    x = np.linspace(0, 10, 60)
    y = 4 * np.exp(-((x - 4.2) ** 2) / (2 * 0.8**2)) + 1
    fit = K.gaussian_profile_fit(x, y, 0.5)
    assert abs(fit["center"] - 4.2) < 1e-3 and abs(fit["sigma"] - 0.8) < 1e-3
    labels = np.array([[[1, 2], [3, 4]]])
    assert K.nearest_labels(labels, (1, 4, 4))[0, 3, 3] == 4
    assert (K.masked_background(np.zeros((3, 3)), 1.0) == 0).all()
    assert K.normalize_background(np.ones((5, 5))).max() == 0
