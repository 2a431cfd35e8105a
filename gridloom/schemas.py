"""Tables of the engine as DDL, and the values that hold everywhere.

Ids that count places in a list (``ordinal``, ``box_number``) are columns, never the order of rows.
"""

from __future__ import annotations

# Columns of the tables.
ITEMS = "ordinal long, image_path string, annotation_path string, is_background boolean"
BOXES = "image_path string, box_number int, xmin long, ymin long, xmax long, ymax long, class_id long"
MANIFEST = "image_id string, image_path string, annotation_path string, is_background boolean, split string, seed int, train_ratio double, val_ratio double, test_ratio double"
INFERENCE_IMAGES = "image_id string, dataset_id string, source_image_path string, source_split string, image_width int, image_height int, prediction_count int, ground_truth_count int"
DETECTIONS = "detection_id string, image_id string, predicted_class_id int, predicted_class_name string, confidence double, xmin double, ymin double, xmax double, ymax double"
GROUND_TRUTH = "ground_truth_id string, image_id string, class_id int, class_name string, xmin double, ymin double, xmax double, ymax double"
COMPARISONS = "comparison_id string, image_id string, detection_id string, ground_truth_id string, iou double, status string"

# Fixed values of the data model.
SPLITS = ("train", "val", "test")
STATUSES = ("true_positive", "class_error", "false_positive", "false_negative")
SIZES = ("small", "medium", "large")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")
CLASS_NAMES = ("airplane", "ship", "storage_tank", "baseball_diamond", "tennis_court", "basketball_court", "ground_track_field", "harbor", "bridge", "vehicle")
FIRST_CLASS, CLASSES = 1, 10
TOLERANCE = 1e-6
