"""Line jobs over files."""
