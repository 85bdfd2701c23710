"""The kinds that a reader gave to 205 documents of the sf0.1 table, before seeing what the classifier said; none is in its training sample."""

HOLDOUT = {
    "prose": [
        58, 81, 245, 292, 408, 683, 914, 1462, 1483, 1930, 2034, 2156, 2199, 2400, 2560, 2586, 2623, 2681, 2906, 2940,
        2963, 3115, 3130, 3253, 3421, 3550, 3783, 3806, 3838, 4067, 4077, 4106, 4669, 4826, 4946, 4958, 5332, 5578,
        5609, 5716, 5811, 6070, 6194, 6257, 6360, 6423, 6457, 6535, 6718, 7107, 7171, 7177, 7349, 7618, 8012, 8031,
        8126, 8714, 8740, 8750, 9267, 9276, 9277, 9460, 9567, 9789,
    ],
    "list": [
        80, 140, 305, 342, 810, 838, 889, 1403, 1554, 1804, 1808, 1928, 2225, 2870, 3016, 3038, 3233, 3352, 3644, 3894,
        4017, 4484, 4638, 4996, 5324, 5939, 6186, 6231, 6236, 6291, 6545, 6556, 6887, 6921, 7255, 7417, 7697, 7814,
        8165, 8204, 8235, 9081, 9444, 9445, 9473, 9573, 9588, 9779, 9978,
    ],
    "table": [
        109, 141, 193, 341, 1156, 1575, 1676, 2172, 2212, 2533, 2772, 2926, 3157, 3479, 3723, 3983, 4398, 4499, 4536,
        4644, 5206, 5989, 6282, 6285, 6437, 6600, 6928, 7045, 7206, 7497, 7658, 7756, 7905, 7941, 8425, 8489, 8613,
        8618, 8850, 9204, 9262, 9376, 9464, 9628,
    ],
    "junk": [
        416, 625, 872, 1370, 1717, 2039, 2197, 2391, 2573, 2988, 3139, 3169, 3528, 3772, 4075, 4420, 4647, 4753, 4797,
        4971, 5081, 5283, 5422, 5461, 5666, 5798, 6031, 6644, 7282, 7620, 8017, 8064, 8186, 8273, 8466, 8493, 8544,
        8632, 8667, 9129, 9271, 9289, 9316, 9753, 9798, 10000,
    ],
}
