"""Line jobs over streams."""
