"""Where rows come from and go to: files, generators and catalogue views."""
